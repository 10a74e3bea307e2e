"""Walks of any depth, with cycles, and ranges that go up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provenant.operators import explore, tree

NODE = "node_id string, parent_id string, level int, start_pos long, end_pos long"


@pytest.fixture(scope="module")
def nodes(spark):
    """A chain of nine levels with a branch, a cycle of three with a leaf, and a node of its own."""
    rows = [(f"n{i}", f"n{i - 1}" if i else None, 9 - i, None, None) for i in range(9)]
    rows += [("leaf", "n8", 0, 10, 12), ("branch", "n4", 0, 3, 4), ("a", "c", 3, None, None), ("b", "a", 2, None, None), ("c", "b", 1, None, None), ("in cycle", "c", 0, 7, 9), ("alone", None, 3, None, None)]
    return spark.createDataFrame(rows, NODE).cache()


def test_descendants_of_nine_levels(nodes):
    got = {(r.node_id, r.depth) for r in tree.descendants(nodes, nodes.where("node_id = 'n0'")).collect()}
    assert got == {(f"n{i}", i) for i in range(9)} | {("leaf", 9), ("branch", 5)}


def test_a_known_depth_stops_there(nodes):
    assert {r.node_id for r in tree.descendants(nodes, nodes.where("node_id = 'n0'"), depth=2).collect()} == {"n0", "n1", "n2"}


def test_cycles_end(nodes):
    got = sorted((r.root_id, r.node_id, r.depth) for r in tree.descendants(nodes, nodes.where("node_id IN ('a', 'b')")).collect())
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "in cycle", 3), ("b", "a", 2), ("b", "b", 0), ("b", "c", 1), ("b", "in cycle", 2)]
    assert sorted((r.node_id, r.depth) for r in tree.ancestors(nodes, nodes.where("node_id = 'in cycle'")).collect()) == [("a", -3), ("b", -2), ("c", -1), ("in cycle", 0)]


def test_ancestors(nodes):
    got = {(r.node_id, r.depth) for r in tree.ancestors(nodes, nodes.where("node_id IN ('branch')")).collect()}
    assert got == {("branch", 0)} | {(f"n{i}", i - 5) for i in range(5)}


def test_covered_range(nodes):
    got = {r.node_id: (r.low, r.high) for r in explore.covered_range(nodes).collect()}
    assert got == {"leaf": (10, 12), "branch": (3, 4), "in cycle": (7, 9)} | {f"n{i}": (10, 12) if i > 4 else (3, 12) for i in range(9)} | dict.fromkeys("abc", (7, 9))


def test_empty_trees(nodes):
    none = nodes.where("false")
    assert tree.descendants(none, none).count() == tree.ancestors(none, none).count() == explore.covered_range(none).count() == 0


def test_walks_of_trees_look_nothing_up_and_broadcast_nothing(spark, nodes, monkeypatch):
    plans, cut = [], tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    whole = spark.createDataFrame([(i, i // 3 if i else None) for i in range(200)], "node_id long, parent_id long")
    want = set()
    for i in range(200):
        up, d = i, 0
        while True:
            want.add((i, up, d))
            if up == 0:
                break
            up, d = up // 3, d + 1
    assert {(r.start_id, r.node_id, -r.depth) for r in tree.ancestors(whole, whole).collect()} == want
    assert "LeftAnti" not in plans[-1] and not any("BroadcastHashJoin" in p for p in plans)
    plans.clear()
    assert {(r.node_id, r.root_id, r.depth) for r in tree.descendants(whole, whole).collect()} == want
    assert not any("LeftAnti" in p or "BroadcastHashJoin" in p for p in plans)


def test_nodes_with_two_parents_are_reached_once(spark):
    rows = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a")]
    n = spark.createDataFrame(rows, "node_id string, parent_id string")
    root = spark.createDataFrame([("a",)], "node_id string")
    assert sorted((r.node_id, r.depth) for r in tree.descendants(n, root).collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 1)]


@pytest.mark.parametrize("rows", [[(i, i // 2 if i else None) for i in range(300)], [(i, i + 1) for i in range(40)], [(1, None), (2, None)], []])
def test_walks_that_end(spark, rows):
    edges = spark.createDataFrame(rows, "here long, there long").where("there IS NOT NULL").where("there <> here")
    assert tree._ends(edges) and tree._ends(edges.where("false"))


@pytest.mark.parametrize("rows", [[(7, 7)], [(1, 2), (2, 1)], [(i, (i + 1) % 9) for i in range(9)], [(i, i + 1) for i in range(20)] + [(20, 18)], [(1, 2), (2, 3), (5, 5)]])
def test_walks_that_go_round(spark, rows):
    assert not tree._ends(spark.createDataFrame(rows, "here long, there long"))


def test_parents_worked_out_from_their_children_do_not_make_plans_grow(spark, monkeypatch):
    sizes, cut = [], tree.cut
    monkeypatch.setattr(tree, "cut", lambda df: sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    n = spark.range(1 << 9).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).alias("parent_id"))
    assert tree.descendants(n, n.where("node_id = 0")).count() == 1 << 9
    assert tree.ancestors(n, n).where("node_id = 0").count() == 1 << 9
    assert max(sizes) < 10_000

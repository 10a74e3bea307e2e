"""Ranks over whole tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import order, retrieval, tree


def test_global_rank_matches_a_sort(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, *range(5)]), r.choice("abc")) for i in range(500)]
    got = order.global_rank(spark.createDataFrame(rows, "id long, score long, kind string").repartition(5), [F.col("score").desc_nulls_last(), F.col("id")], ranges=7)
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [tuple(x)[:3] for x in sorted(got.collect(), key=lambda x: x["rank"])] == want
    assert sorted(x["rank"] for x in got.collect()) == list(range(1, 501))


def test_global_rank_of_one_value_and_of_nothing(spark):
    same = order.global_rank(spark.range(50).withColumn("score", F.lit(1)), [F.col("score")], "place")
    assert sorted(x["place"] for x in same.collect()) == list(range(1, 51))
    assert order.global_rank(spark.range(0), [F.col("id")]).count() == 0


def test_previous_and_running_count_over_blocks(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), at, r.random() < 0.3) for at in r.sample(range(400), 200)]
    df = spark.createDataFrame(rows, "kind string, at long, flag boolean").withColumn("block", F.floor(F.col("at") / 7)).repartition(3)
    got = order.running_count(order.previous(df, ["kind"], "block", "at", F.struct("at", "flag"), "before"), ["kind"], "block", "at", F.col("flag"), "n")
    seen = {(x.kind, x["at"]): (x.before and tuple(x.before), x.n) for x in got.collect()}
    assert len(seen) == len(rows)
    for kind in ("a", "b", None):
        last, n = None, 0
        for _, at, flag in sorted((x for x in rows if x[0] == kind), key=lambda x: x[1]):
            n += flag
            assert seen[kind, at] == (last, n)
            last = (at, flag)


def test_as_of_over_ranges(spark):
    r = random.Random(6)
    left = spark.createDataFrame([(r.choice(["a", "b", None]), r.choice([None, *range(40)]), i) for i in range(300)], "g string, t int, id int")
    right = spark.createDataFrame([(r.choice(["a", "b"]), r.randint(0, 40), r.choice([None, "x", "y", "z"]), i) for i in range(60)], "g string, t int, v string, o int")
    told = lambda ranges: sorted(map(str, tree.as_of(left, right, "g", "t", "t", "v", "o", ranges).collect()))
    assert told(None) == told(7) == told(1)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_trees_do_not_depend_on_blocks(spark, block, monkeypatch):
    r = random.Random(7)
    rows = [(v, i, r.choice(["text", "text", "table", "page_number", "header"]), i // 9, r.choice([None, 1]), r.choice(["words here", "more", " ", ""])) for v in ("v", "w") for i in range(60)]
    items = spark.createDataFrame(rows, "version_id string, pos int, type string, page_idx int, text_level int, text string")
    for name, kind in (("bbox", "array<array<double>>"), ("table_body", "string"), ("img_path", "string"), ("source_element_id", "string"), *((c, "array<string>") for c in ("table_caption", "table_footnote", "image_caption", "image_footnote", "list_items"))):
        items = items.withColumn(name, F.lit(None).cast(kind))
    key = lambda: sorted(map(str, tree.build(items).collect()))
    whole = key()
    monkeypatch.setattr(tree, "BLOCK", block)
    assert key() == whole and len(whole) > 20


@pytest.mark.parametrize("block", [1, 5, 17, 1000])
@pytest.mark.parametrize(("most", "width"), [(3, 40), (1, 1000), (100, 30), (4, 1)])
def test_token_batches_over_blocks(spark, block, most, width, monkeypatch):
    r = random.Random(8)
    rows = [(v, at, f"{v}{at}", r.choice([None, "", "x" * r.randint(0, 40)])) for v in ("v", "w") for at in r.sample(range(90), 60)]
    monkeypatch.setattr(retrieval, "BATCH_BLOCK", block)
    got = retrieval.token_batches(spark.createDataFrame(rows, "version_id string, chunk_index int, chunk_id string, text_raw string").repartition(3), most, width)
    want = []
    for v in ("v", "w"):
        batch = count = total = 0
        for _, _, key, text in sorted((x for x in rows if x[0] == v), key=lambda x: x[1]):
            n = len(text) // 2 + 1 if text is not None else 0
            if count and (count >= most or total + n > width):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + n
            want.append((v, key, batch))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_trees_shuffle_text_only_for_content(spark, monkeypatch):
    items = spark.range(40).selectExpr(
        "'v' AS version_id", "id AS pos", "'text' AS type", "CAST(id div 10 AS int) AS page_idx", "concat('line ', id) AS text", "IF(id % 5 = 0, 1, null) AS text_level", "CAST(null AS string) AS table_body",
        *(f"CAST(null AS array<string>) AS {c}" for c in ("table_caption", "table_footnote", "image_caption", "image_footnote", "list_items")),
    )
    nodes = tree.build(items)
    sizes = nodes.where("level > 1").select("level", F.size("children_ids").alias("n"))
    shuffled = [x for x in nodes.select("level", "children_ids")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x]
    assert shuffled and not any("body" in x for x in shuffled)
    assert sorted((r.level, r.n) for r in sizes.collect()) == [(2, 2)] * 8 + [(3, 8)]
    joined, as_of = [], tree.as_of
    monkeypatch.setattr(tree, "as_of", lambda left, *more: joined.append(left.columns) or as_of(left, *more))
    chunks = spark.createDataFrame([("v", i, i // 3 if i < 9 else None, f"text {i}") for i in range(12)], "version_id string, chunk_id int, page_idx int, text_raw string")
    told = tree.contextual(chunks, nodes.select("version_id", "level", "heading", "page_start", "start_pos"))
    assert joined == [["version_id", "page_idx"]] and told.columns == [*chunks.columns, "section_title", "contextual_text"]
    assert {r.chunk_id: r.contextual_text for r in told.collect()} == {i: f"[line {i // 3 * 10 + 5}] text {i}" if i < 9 else f"text {i}" for i in range(12)}

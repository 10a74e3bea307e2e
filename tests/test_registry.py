"""Registries, reranked lists, vocabularies that grow, and compiled policies."""

from __future__ import annotations

import json

import pytest

from provenant.operators import retrieval, sinks, tree
from provenant.sources import config, content


def test_registered_rows_keep_their_ids(spark):
    old = spark.createDataFrame([("v", "a", "id1", 1, "pdf"), (None, "b", "id2", 2, None)], "version string, path string, file_id string, since int, kind string")
    new = spark.createDataFrame([("v", "a", "id9", 9, "json"), (None, "b", "id8", 8, "zip"), ("w", "a", "id7", 7, "md")], old.schema)
    got = sorted((r.path, r.file_id, r.since, r.kind) for r in sinks.register(old, new, ["version", "path"], ["file_id", "since"]).collect())
    assert got == [("a", "id1", 1, "json"), ("a", "id7", 7, "md"), ("b", "id2", 2, "zip")]


def test_what_a_reranker_leaves_out_follows(spark):
    results = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(["x", "same", "y", "same", "z", "late", "later"])] + [(2, 9, 0, "x")], "query_id int, chunk_id int, rank0 int, text_raw string")
    ranking = spark.createDataFrame([(1, "same", 0, 0.9), (1, "nowhere", 1, 0.8), (1, "z", 2, None), (1, "same", 3, 0.1), (1, "late", 4, 0.0)], "query_id int, text_raw string, nth int, rerank_score double")
    got = {q: [(r.chunk_id, r.rerank_score) for r in sorted(rows, key=lambda r: r.rank0)] for q in (1, 2) for rows in [[r for r in retrieval.rerank_listed(results, ranking, 3).collect() if r.query_id == q]]}
    assert got == {1: [(1, 0.9), (4, None), (3, 0.1)], 2: [(9, None)]}
    wide = sorted((r.rank0, r.chunk_id) for r in retrieval.rerank_listed(results, ranking.where("nth < 1"), 4).where("query_id = 1").collect())
    assert wide == [(0, 1), (1, 0), (2, 2), (3, 3)]


def test_vocabularies_grow():
    own = {"质保": ["保修", "质保"]}
    more = retrieval.extended(own, {"质保": ["售后", "保修", "售后"], "交付": ["交货"]})
    assert more == {"质保": ["保修", "质保", "售后"], "交付": ["交付", "交货"]} and own == {"质保": ["保修", "质保"]}
    assert retrieval.synonym_index(more)["交货"] == "交付" and retrieval.extended(more, {}) == more


POLICY = {
    "constraints": ["only evidence"], "workflow": {"tool_calling_required": True, "max_turns_default": 3, "required_tools": ["search"]},
    "scoring": {"baseline_score": 50, "min_score": 0, "max_score": 100, "positive_evidence_delta_range": [1, 5], "risk_evidence_delta_range": [1, 9]}, "risk_rules": {"high": "a", "medium": "b", "low": "c"},
    "output": {"strict_json": True, "schema_hint": "{}"}, "retrieval": {"default_mode": "hybrid", "default_top_k": 5}, "evidence_gate": {"default_min_citations": 1, "require_page_idx": True, "require_bbox": True, "require_quote": True},
}


def test_policies_come_back_from_artifacts(tmp_path):
    policy = config.Policy("pack", "strict", config.validate_policy(POLICY))
    at = tmp_path / "policy.json"
    at.write_text(json.dumps(config.policy_artifact(policy)))
    assert config.read_policy_artifact(at) == policy
    changed = config.policy_artifact(policy)
    changed["policy"] = {**POLICY, "constraints": ["anything goes"]}
    at.write_text(json.dumps(changed))
    with pytest.raises(config.ConfigError, match="not the one that was compiled"):
        config.read_policy_artifact(at)
    for broken in ("{", "[]", '{"policy": {}}'):
        at.write_text(broken)
        with pytest.raises(config.ConfigError):
            config.read_policy_artifact(at)
    with pytest.raises(config.ConfigError):
        config.read_policy_artifact(tmp_path / "none.json")


NODE = "node_id string, version_id string, parent_id string, level int, content string"


def test_trees_come_whole_or_not_at_all(spark):
    old = spark.createDataFrame([("r", "v", None, 3, "was"), ("x", "w", None, 3, "stays"), ("z", None, None, 3, "none")], NODE)
    sound = [("r", "v", None, 3, "now"), ("s", "v", "r", 2, "s"), ("p", "v", "s", 1, ""), ("q", None, "z", 2, "q")]
    orphan = [("x", "w", None, 3, "new"), ("y", "w", "s", 1, "parent of another version, not there before")]
    others = [("a", "u", "b", 1, "parent not above"), ("b", "u", "a", 1, "b"), ("c", "t", None, 4, "no such level"), ("d", "t2", None, 3, None)]
    table, counts = sinks.upsert_tree(old, spark.createDataFrame(sound + orphan + others, NODE))
    assert sorted(map(tuple, table.collect()), key=str) == sorted(sound + [("x", "w", None, 3, "stays"), ("z", None, None, 3, "none")], key=str)
    told = {(r.version_id, r.level): (r.written, r.failed) for r in counts.collect()}
    assert told == {("v", 3): (1, 0), ("v", 2): (1, 0), ("v", 1): (1, 0), (None, 2): (1, 0), ("w", 3): (0, 1), ("w", 1): (0, 1), ("u", 1): (0, 2), ("t", 4): (0, 1), ("t2", 3): (0, 1)}
    none = sinks.upsert_tree(old, old.limit(0))
    assert none[0].count() == 3 and none[1].count() == 0


def test_a_tree_is_written_by_one_swap_and_again(spark, tmp_path):
    rows = [{"type": "text", "text_level": 1, "text": "Title", "page_idx": 0}, {"type": "text", "text": "one", "page_idx": 0}, {"type": "text", "text": "two", "page_idx": 1}]
    nodes = tree.stored(tree.build(content.items_of(spark.createDataFrame([("v", json.dumps(rows))], "version_id string, content string"))))
    at = str(tmp_path / "tree")
    first = {r.level: (r.written, r.failed) for r in sinks.write_tree(spark, nodes, at).collect()}
    held = sorted(map(str, spark.read.parquet(at).collect()))
    assert set(first) == {0, 1, 2, 3} and all(w > 0 and not f for w, f in first.values())
    again = {r.level: (r.written, r.failed) for r in sinks.write_tree(spark, nodes, at).collect()}
    assert again == first and sorted(map(str, spark.read.parquet(at).collect())) == held
    leaf = spark.read.parquet(at).where("level = 0").orderBy("covered_unit_range.start").first()
    assert leaf.start_chunk_id == leaf.end_chunk_id == leaf.source_chunk_ids[0] and leaf.node_type == "sentence"

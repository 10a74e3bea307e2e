"""Scoring backends and a whole evaluation on generated documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provenant.operators import backends, evalkit, ingest, retrieval, scoring, tree
from provenant.sources import synthetic

DIMS = scoring.DIMENSIONS[:2]


@pytest.fixture(scope="module")
def generated(spark):
    items, qrels = synthetic.generate(spark, scenarios=2, pages=16)
    return items.cache(), qrels.cache()


def test_generated_documents_are_sound(generated):
    assert synthetic.check(*generated) == {"items": 320, "qrels": 40, "unresolved": 0}


def test_retrieval_finds_answers(spark, generated):
    items, qrels = generated
    chunks = ingest.ingest(items).chunks
    words = [("warranty", "质保"), ("delivery", "响应"), ("training", "培训"), ("financial", "预付")]
    q = spark.createDataFrame([(f"{v}/{t}", v, [w], w) for v in ("scenario_0", "scenario_1") for t, w in words], "query_id string, version_id string, keywords array<string>, query string").withColumn("embedding", retrieval.hash_embedding("query"))
    found = retrieval.ranked(chunks, q, 5, "keyword").select(F.lit("keyword").alias("method"), "query_id", "chunk_id", (F.col("rank0") + 1).alias("rank"))
    judged = evalkit.map_qrels(qrels, chunks).withColumn("query_id", F.concat_ws("/", "version_id", "query_id"))
    for r in evalkit.metrics(found, judged).collect():
        assert r.mrr == 1.0 and r.recall_at_1 == 1.0


def test_backends_agree_on_shape(spark, generated):
    chunks = ingest.ingest(generated[0]).chunks.withColumn("evidence_status", F.lit("verified"))
    rules = backends.analyzer(chunks, DIMS)
    base = {(r.version_id, r.dimension): r.score for r in rules.results.collect()}
    assert len(base) == 4
    judge = lambda e: e.groupBy("version_id", "dimension").agg(F.lit(100.0).alias("score"), F.lit("low").alias("risk_level"))
    blended = {(r.version_id, r.dimension): r.score for r in backends.hybrid(chunks, judge, DIMS, weight=0.7).results.collect()}
    assert blended == {k: round(70 + 0.3 * v, 2) for k, v in base.items()}
    alone = backends.agent(chunks, None, DIMS)
    assert alone.warnings == ("scoring_backend_agent_mcp_fallback",) and {(r.version_id, r.dimension): r.score for r in alone.results.collect()} == base
    unproven = backends.agent(chunks.withColumn("evidence_status", F.lit("unverifiable")), judge, DIMS)
    assert {r.score for r in unproven.results.collect()} == {50.0} and unproven.citations.count() == 0
    with pytest.raises(ValueError):
        backends.backend("odd")
    with pytest.raises(ValueError):
        backends.hybrid_weight(1.5)


def test_replies_of_models():
    from decimal import Decimal
    from uuid import UUID

    rows = [{"name": "a", "score": 70, "risk_level": "low"}]
    for text in ('{"dimensions": [{"name": "a", "score": 70, "risk_level": "low"}]}', 'Here:\n```json\n[{"dimension": "a", "score": 70, "risk_level": "low"}]\n```', 'so {"a": {"score": 70, "risk_level": "low"}} it is'):
        assert backends.parse_reply(text) == rows
    with pytest.raises(ValueError):
        backends.parse_reply("none")
    assert backends.plain({"id": UUID(int=1), "page": Decimal("2"), "box": [Decimal("1.5"), 3]}) == {"id": "00000000-0000-0000-0000-000000000001", "page": 2, "box": [1.5, 3]}


def test_model_judge_reads_evidence_by_tool(spark):
    def complete(messages):
        if len(messages) == 1:
            return {"calls": [{"id": "1", "name": "evidence", "arguments": {"dimension": "a"}}, {"id": "2", "name": "odd"}]}
        assert "unknown tool" in messages[-1]["content"]
        return {"text": '{"a": {"score": %d, "risk_level": "low"}, "z": 1}' % (90 if "good" in messages[2]["content"] else 10)}

    usable = spark.createDataFrame([("v", "a", "c1", 1, "good"), ("w", "a", "c2", None, "bad"), ("w", "b", "c3", 1, "x")], "version_id string, dimension string, chunk_id string, page_idx int, text_raw string")
    got = sorted(map(tuple, backends.model_judge(complete)(usable).collect()))
    assert got == [("v", "a", "90", "low"), ("w", "a", "10", "low")]
    assert backends.model_judge(lambda m: {"text": "no"})(usable).collect() == []
    with pytest.raises(TimeoutError):
        backends.converse(lambda m: {"calls": [{"name": "t"}]}, "p", {"t": lambda: 1}, 3)


def test_object_store(spark, tmp_path):
    from provenant.sources.objects import Objects

    store = Objects.from_env(spark, {"OBJECT_STORE_ROOT": str(tmp_path / "store")})
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("x")
    (tmp_path / "one.txt").write_text("one")
    store.upload(str(tmp_path / "one.txt"), "a/one.txt")
    store.upload(str(tmp_path / "d"), "b")
    assert store.exists("a/one.txt") and not store.exists("a/two.txt") and store.list().count() == 2 and store.list("b").count() == 1
    store.download("a/one.txt", str(tmp_path / "back.txt"))
    assert (tmp_path / "back.txt").read_text() == "one"
    assert store.delete("b") and not store.exists("b/x.txt") and not store.delete("b")
    with pytest.raises(FileNotFoundError):
        store.download("none", str(tmp_path / "n"))
    with pytest.raises(ValueError):
        store.link("a/one.txt")
    assert Objects(spark, "r", lambda k, s: f"{k}?{s}").link("k", 5) == "k?5"


def test_parsers(spark, tmp_path):
    from provenant.sources import content
    from provenant.sources.objects import command_parser, first_of, http_parser

    said = '{"content_list": [{"type": "text", "text": "hello", "page_idx": 0}]}'
    command = command_parser(["no-such-command"], ["sh", "-c", f"cat > /dev/null; echo '{said}'"])
    asked = []

    def fetch(url, body):
        asked.append(url)
        if len(asked) == 1:
            raise OSError("away")
        return (b'{"poll_url": "p"}' if len(asked) < 4 else said.encode())

    assert http_parser("u", pause=0.0, fetch=fetch)(b"x") == command(b"x") and asked == ["u", "u", "p", "p"]
    with pytest.raises(FileNotFoundError):
        command_parser(["no-such-command"])(b"x")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    items, _ = content.load(spark, pdf=str(tmp_path / "a.pdf"), parse=content.parse_with(first_of(command_parser(["no-such-command"]), command)))
    assert [r.text for r in items.collect()] == ["hello"]


def test_cache_and_resources(spark):
    from provenant import api

    chunks = spark.createDataFrame([("v", "c1", 0, 0, "the key: 5 years", "text", None), ("w", "c2", 0, 0, "x", "text", None)], "version_id string, chunk_id string, chunk_index int, page_idx int, text_raw string, element_type string, text_level int")
    pages = spark.createDataFrame([("v", 0, "s", 1.0, 2.0)], "version_id string, page_idx int, coord_sys string, page_w double, page_h double")
    units = spark.createDataFrame([("v", "u1", 0, "text", "the key", None, "{}", "s", "h")], "version_id string, unit_id string, unit_index int, unit_type string, text_raw string, anchor string, anchor_json string, source_element_id string, unit_hash string")
    spans = spark.createDataFrame([("v", "c1", "u1", 0, 0, 3)], "version_id string, chunk_id string, unit_id string, unit_order int, start_char int, end_char int")
    store = api.Store(spark, tables={"chunks": chunks, "pages": pages, "units": units, "spans": spans})
    cache = api.Cache(2)
    for keys in (["key"], ["key"], ["years"], ["x"], ["key"]):
        assert cache.get(api.extract_key_value, store, "v", key_patterns=keys).count() == (keys != ["x"])
    assert cache.stats() == {"size": 2, "hits": 1, "misses": 4}
    cache.forget("w")
    assert cache.stats()["size"] == 2
    cache.forget("v")
    assert cache.stats()["size"] == 0
    chunk = api.resource(store, "chunk/c1").first()
    assert chunk.page_w == 1.0 and chunk.evidence_units[0].unit_id == "u1"
    assert api.resource(store, "limits") == api.LIMITS and "tools" in api.resource(store, "health")
    with pytest.raises(api.InvalidArgument):
        api.resource(store, "odd/1")


def test_node_cap(spark):
    nodes = spark.createDataFrame([("v", str(i)) for i in range(5)] + [("w", "0")], "version_id string, node_id string")
    kept, over = tree.capped(nodes, 4)
    assert kept.count() == 1 and over.collect() == [("v", 5)]

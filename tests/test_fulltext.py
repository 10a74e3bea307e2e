"""The inverted index, the query tree, and search over both."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import fulltext, retrieval, trigrams


def tree_of(spark, text):
    row = spark.createDataFrame([(text,)], "q string").select(fulltext.parse("q").alias("t")).first()
    return [[("-" if x.negated else "") + "+".join(x.words) for x in terms] for terms in row.t]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("  ", []), ("a", [["a"]]), ("a b", [["a", "b"]]), ("a -b", [["a", "-b"]]), ("a - b", [["a", "-b"]]), ("--a", [["a"]]), ('"two Words" x', [["two+words", "x"]]), ('-"two words" x', [["-two+words", "x"]]),
        ("a OR b c", [["a"], ["b", "c"]]), ("or a", [["or", "a"]]), ("a or", [["a", "or"]]), ("a or or b", [["a"], ["or", "b"]]), ("a or -b", [["a"], ["-b"]]), ("order a", [["order", "a"]]), ("foo-bar's", [["foo+bar+s"]]),
        ('"open to the end', [["open+to+the+end"]]), ('a"b c"d', [["a", "b+c", "d"]]), ("!!! a", [["a"]]), ("!!! or a", [["a"]]), ('""', []), ('a or "!" or b', [["a"], ["b"]]),
    ],
)
def test_parse(spark, text, want):
    assert tree_of(spark, text) == want


def test_queries_that_no_index_serves(spark):
    q = spark.createDataFrame([("-a",), ("a or -b",), ("",), ("a -b",), ("!!!",)], "q string")
    assert [r.ok for r in q.select(fulltext.indexable(fulltext.parse("q")).alias("ok")).collect()] == [False, False, False, True, False]


TEXTS = ["alpha beta", "alpha gamma", "beta gamma x alpha", "", None, "Alpha, beta. ALPHA-beta beta alpha", "gamma", "漢字 alpha"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("v", i, t) for i, t in enumerate(TEXTS)] + [("w", 100, "alpha beta")], "version_id string, chunk_id long, text_raw string")


def found(spark, chunks, *queries):
    q = spark.createDataFrame([(i, "v", x) for i, x in enumerate(queries)], "query_id long, version_id string, q string").withColumn("tree", fulltext.parse("q"))
    out = {i: [] for i in range(len(queries))}
    for r in sorted(fulltext.search(fulltext.postings(chunks), q, 10).collect(), key=lambda r: r.rank0):
        out[r.query_id].append(r.chunk_id)
    return [sorted(x) for x in out.values()]


def test_search(spark, chunks):
    asked = ("alpha -beta", '"alpha beta"', '"beta alpha"', "gamma or beta", "-alpha", '-"beta gamma" gamma', "漢字", "beta gamma", "nothing")
    assert found(spark, chunks, *asked) == [[1, 7], [0, 5], [5], [0, 1, 2, 5, 6], [], [1, 6], [7], [2], []]


def test_postings(spark, chunks):
    got = {(r.version_id, r.lexeme, r.chunk_id): list(r.positions) for r in fulltext.postings(chunks).collect()}
    assert got["v", "alpha", 5] == [0, 2, 5] and got["v", "beta", 5] == [1, 3, 4] and got["w", "beta", 100] == [1] and len(got) == 2 + 2 + 4 + 2 + 1 + 2 + 2


def slow_density(tree, words):
    """Covers by trying every stretch of the words that matter: the earliest end, then the latest begin."""
    wanted = {w for terms in tree for ws, _ in terms for w in ws}
    at = [(i, w) for i, w in enumerate(words) if w in wanted]

    def ok(part):
        there = set(part)
        occurs = lambda ws: any(all((p + i, w) in there for i, w in enumerate(ws)) for p, _ in part)
        return any(all(occurs(ws) != no for ws, no in terms) for terms in tree)

    total, begin = 0.0, 0
    while begin < len(at):
        ends = [e for e in range(begin, len(at)) if ok(at[begin : e + 1])]
        if not ends:
            break
        starts = [s for s in range(ends[0], begin - 1, -1) if ok(at[s : ends[0] + 1])]
        s, e = starts[0], ends[0]
        total += 0.1 / (1 + at[e][0] - at[s][0] - (e - s))
        begin = s + 1
    return total


def test_density_matches_every_stretch():
    r = random.Random(4)
    for _ in range(400):
        words = [r.choice("abcdx") for _ in range(r.randint(0, 14))]
        tree = [[([r.choice("abcd") for _ in range(r.choice([1, 1, 2]))], r.random() < 0.2) for _ in range(r.randint(1, 2))] for _ in range(r.randint(1, 2))]
        held = {}
        for i, w in enumerate(words):
            if w in {w for terms in tree for ws, _ in terms for w in ws}:
                held.setdefault(w, []).append(i)
        assert fulltext.density(tree, held) == pytest.approx(slow_density(tree, words))


def test_equals_the_search_over_texts(spark):
    r = random.Random(6)
    chunks = spark.createDataFrame([(r.choice("vw"), i, " ".join(r.choice(["data", "of", "The", "set", "x-ray", "plan"]) for _ in range(r.randint(0, 40)))) for i in range(200)], "version_id string, chunk_id long, text_raw string")
    rows = [(0, "v", ["data", "set of"]), (1, "w", ["x-ray"]), (2, "v", ["plan"]), (3, "w", []), (4, "v", ["nothing here"]), (5, "w", ["the", "data", "plan of the"])]
    queries = spark.createDataFrame(rows, "query_id long, version_id string, keywords array<string>")
    index = fulltext.postings(chunks)
    for any_keyword in (True, False):
        want = retrieval.fulltext_search(chunks, queries, 10, any_keyword)
        got = fulltext.search(index, queries.withColumn("tree", fulltext.of_keywords("keywords", any_keyword)), 10)
        key = lambda df: sorted((x.query_id, x.chunk_id, round(x.score, 9), x.rank0) for x in df.collect())
        assert key(got) == key(want) and key(got)


def test_no_text_is_read(spark, chunks, tmp_path):
    fulltext.postings(chunks).write.parquet(str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "v", "alpha")], "query_id long, version_id string, q string").withColumn("tree", fulltext.parse("q"))
    got = fulltext.search(spark.read.parquet(str(tmp_path / "index")), q, 10)
    plan = got._jdf.queryExecution().toString()
    assert "text_raw" not in plan and got.count() == 5


def test_many_terms_are_not_broadcast(spark, chunks, monkeypatch):
    monkeypatch.setattr(fulltext, "BROADCAST_TERMS", 0)
    assert found(spark, chunks, "alpha -beta", "gamma or beta") == [[1, 7], [0, 1, 2, 5, 6]]


def test_extra_columns_and_empty_tables(spark, chunks):
    more = chunks.withColumn("lexeme", F.lit("clash")).withColumn("positions", F.lit(1))
    assert fulltext.postings(more).count() == 15
    q = spark.createDataFrame([(1, "v", "alpha")], "query_id long, version_id string, q string").withColumn("tree", fulltext.parse("q"))
    assert fulltext.search(fulltext.postings(chunks.where("false")), q, 5).count() == 0
    assert fulltext.search(fulltext.postings(chunks), q.where("false"), 5).count() == 0


@pytest.mark.parametrize("any_keyword", [True, False])
def test_keyword_search_from_indexes(spark, any_keyword):
    r = random.Random(9)
    chunks = spark.createDataFrame([(r.choice("vw"), i, " ".join(r.choice(["data", "of", "The", "保修期", "x-ray", "plan"]) for _ in range(r.randint(0, 20)))) for i in range(150)], "version_id string, chunk_id long, text_raw string")
    rows = [(0, "v", ["data", "set of"]), (1, "w", ["保修", "data"]), (2, "v", ["pla"]), (3, "w", []), (4, "v", ['"', "nothing here"]), (5, "w", ["a", "ray"]), (6, "v", ['"of"'])]
    queries = spark.createDataFrame(rows, "query_id long, version_id string, keywords array<string>")
    key = lambda df: sorted((x.query_id, x.chunk_id, round(x.score, 9), x.rank0) for x in df.collect())
    got = fulltext.keyword_search(fulltext.postings(chunks), trigrams.index(chunks), chunks, queries, 10, any_keyword)
    assert key(got) == key(retrieval.keyword_search(chunks, queries, 10, any_keyword)) and key(got)

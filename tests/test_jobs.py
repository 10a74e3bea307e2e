"""The jobs: two runs over growing input, repeated runs, failures in between, command lines."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from jobs import common, fulltext_index, queries, retrieval_report

DOCS = "doc_id long, text string, lang string"
FIRST = [(1, "The cat sat", "en"), (2, "Der Hund", "de"), (3, None, "en"), (4, "cat, cat! cat", "en"), (None, "lost", "en"), (5, "", None)]
SECOND = [(2, "Der Hund bellt", "de"), (6, "a cat", "en"), (1, "No more", "fr"), (6, "a cat", "en")]


def words(text):
    return {w: [i for i, x in enumerate((text or "").lower().replace(",", "").replace("!", "").split()) if x == w] for w in (text or "").lower().replace(",", "").replace("!", "").split()}


def rows_of(*batches):
    """version, lexeme, id and positions of the last text of every id."""
    last = {i: (lang, text) for batch in batches for i, text, lang in batch if i is not None}
    return sorted((lang or "", w, str(i), tuple(at)) for i, (lang, text) in last.items() for w, at in words(text).items())


def there(spark, output):
    return sorted((r.version_id or "", r.lexeme, r.chunk_id, tuple(r.positions)) for r in fulltext_index.current(spark, output).collect())


def add(spark, rows, folder, n):
    spark.createDataFrame(rows, DOCS).withColumn("batch", F.lit("clash")).coalesce(1).write.mode("append" if n else "overwrite").parquet(folder)


@pytest.fixture
def paths(tmp_path):
    return [str(tmp_path / name) for name in ("documents", "output", "checkpoint")]


CONFIG = common.settings("fulltext_index")


def test_only_new_files_are_taken(spark, paths):
    add(spark, FIRST, paths[0], 0)
    assert fulltext_index.run(spark, *paths, CONFIG) == {"batches": 1, "rows_read": 6, "without_id": 1, "chunks": 5, "postings": 6}
    assert there(spark, paths[1]) == rows_of(FIRST)
    add(spark, SECOND, paths[0], 1)
    report = fulltext_index.run(spark, *paths, CONFIG)
    assert report["batches"] == 1 and report["rows_read"] == 4 and report["chunks"] == 5 + 3
    assert there(spark, paths[1]) == rows_of(FIRST, SECOND)
    assert fulltext_index.run(spark, *paths, CONFIG)["batches"] == 0
    assert there(spark, paths[1]) == rows_of(FIRST, SECOND)


def test_a_batch_that_failed_runs_again_to_the_same_end(spark, paths, monkeypatch):
    add(spark, FIRST, paths[0], 0)
    fulltext_index.run(spark, *paths, CONFIG)
    add(spark, SECOND, paths[0], 1)
    write, calls = fulltext_index.write, []

    def dies(rows, path):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost between the two tables")
        write(rows, path)

    monkeypatch.setattr(fulltext_index, "write", dies)
    with pytest.raises(Exception, match="lost between the two tables"):
        fulltext_index.run(spark, *paths, CONFIG)
    monkeypatch.setattr(fulltext_index, "write", write)
    assert fulltext_index.run(spark, *paths, CONFIG)["batches"] == 1
    assert there(spark, paths[1]) == rows_of(FIRST, SECOND)


def test_batches_of_few_files(spark, paths):
    for n, rows in enumerate((FIRST, SECOND, [(7, "last", "en")])):
        add(spark, rows, paths[0], n)
    report = fulltext_index.run(spark, *paths, CONFIG | {"files_per_batch": 1})
    assert report["batches"] == 3 and report["rows_read"] == 11
    assert ("en", "last", "7", (0,)) in there(spark, paths[1])


def test_empty_files_make_an_empty_index(spark, paths):
    add(spark, FIRST[:0], paths[0], 0)
    assert fulltext_index.run(spark, *paths, CONFIG)["postings"] == 0 and there(spark, paths[1]) == []


def test_repeated_and_superseded_ids_beyond_the_broadcast(spark, paths, monkeypatch):
    """Many ids that come again, in a batch and in later ones, give the same index by a shuffle."""
    monkeypatch.setattr(fulltext_index, "BROADCAST_IDS", 0)
    for n, rows in enumerate((FIRST, [*SECOND, (6, "a greater cat", "en")])):
        add(spark, rows, paths[0], n)
        fulltext_index.run(spark, *paths, CONFIG)
    assert there(spark, paths[1]) == rows_of(FIRST, [*SECOND, (6, "a greater cat", "en")])


def test_postings_are_neither_sorted_nor_shuffled(spark, paths):
    """Texts and postings are many times the ids; an index of few repeated ids moves neither through an exchange or a sort."""
    add(spark, FIRST, paths[0], 0)
    fulltext_index.run(spark, *paths, CONFIG)
    add(spark, SECOND, paths[0], 1)
    fulltext_index.run(spark, *paths, CONFIG)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        now = fulltext_index.current(spark, paths[1])
        plan = now._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    docs = spark.read.parquet(paths[0]).select(F.col("lang").alias("version_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("text_raw"))
    assert "Exchange" not in fulltext_index.once(docs, 0)._jdf.queryExecution().executedPlan().toString()


def test_versions_that_look_like_numbers_stay_strings(spark, paths):
    add(spark, [(1, "one", "007"), (2, "two", "7")], paths[0], 0)
    fulltext_index.run(spark, *paths, CONFIG)
    assert there(spark, paths[1]) == [("007", "one", "1", (0,)), ("7", "two", "2", (0,))]


def test_a_path_matches_itself_only():
    assert fulltext_index.pattern("hdfs://x/a/docs.parquet/") == "hdfs://x/a/docs.parque[t]" and fulltext_index.pattern("/a/*.parquet") == "/a/*.parquet"


# -- the report -----------------------------------------------------------------------------------


REPORT = common.settings("retrieval_report") | {"top_k": 3, "ks": [1, 3], "every": 2, "keywords": [["alpha"], ["beta", "no such word"]], "thresholds": {"vector": {"mrr": 1.1}, "keyword": {"mrr": 0.0}}}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("report")
    texts = ["alpha beta", "alpha", "beta", None, "gamma alpha", "beta beta alpha", ""]
    spark.createDataFrame([(i, t, "en" if i % 3 else "de") for i, t in enumerate(texts)], DOCS).write.parquet(str(at / "documents"))
    spark.createDataFrame([(i, [float(i % 2), 1.0, float(i)], i % 2) for i in range(6)], "vec_id long, embedding array<float>, label int").write.parquet(str(at / "embeddings"))
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels"))
    return [str(at / name) for name in ("documents", "embeddings", "labels")]


def read(spark, output, name, config=REPORT):
    df = retrieval_report.table(spark, output, name, config)
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_report_of_runs(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    report = retrieval_report.run(spark, *tables, out, REPORT)
    first = [read(spark, out, name) for name in ("answers", "per_query", "violations")]
    assert report["documents"] == 7 and report["answers"] == len(first[0]) and report["violations"] == 1
    retrieval_report.run(spark, *tables, out, REPORT)
    assert [read(spark, out, name) for name in ("answers", "per_query", "violations")] == first
    answers = {(r.method, r.query_id, r["rank"]): (r.chunk_id, r.relevance) for r in retrieval_report.table(spark, out, "answers", REPORT).collect()}
    assert answers["vector", 2, 1] == (2, 3) and answers["keyword", 2, 1] == (5, 0) and answers["keyword", 4, 1] == (1, 1)
    each = {(r.method, r.query_id): r for r in retrieval_report.table(spark, out, "per_query", REPORT).collect()}
    assert each["vector", 2].mrr == 1.0 and each["vector", 2].ndcg_at_1 == 1.0 and each["keyword", 2].mrr == 0.5
    assert {m for m, _ in each} == {"vector", "keyword", "hybrid"}
    violation = retrieval_report.table(spark, out, "violations", REPORT).collect()
    assert [(v.method, v.metric, v.minimum) for v in violation] == [("vector", "mrr", 1.1)]


def test_report_of_empty_tables(spark, tables, tmp_path):
    empty = []
    for p in tables:
        spark.read.parquet(p).where("false").write.parquet(at := f"{tmp_path}/{p.rsplit('/', 1)[1]}")
        empty.append(at)
    report = retrieval_report.run(spark, *empty, str(tmp_path / "out"), REPORT)
    assert report["answers"] == report["per_query"] == 0 and report["violations"] == 1


def test_settings():
    with pytest.raises(ValueError, match="unknown settings: ids"):
        common.settings("fulltext_index", ids=1)
    assert common.settings("fulltext_index", text="body")["text"] == "body"


def test_command_line(spark, paths, tmp_path, capsys, monkeypatch):
    """The command line hands over its paths and settings, and prints the report; the session is not its own here."""
    add(spark, FIRST, paths[0], 0)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    (tmp_path / "own.json").write_text(json.dumps({"files_per_batch": 3}))
    args = [x for name, p in zip(fulltext_index.FOLDERS, paths, strict=True) for x in (f"--{name}", p)]
    assert common.main("fulltext_index", fulltext_index.run, fulltext_index.FOLDERS, [*args, "--config", str(tmp_path / "own.json")]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["rows_read"] == 6


def test_registered_jobs_leave_settings_as_they_are(spark):
    at = "/root/testdata/sf0.001"
    try:
        spark.read.parquet(f"{at}/documents.parquet")
    except Exception:
        pytest.skip("the driver's tables are not here")
    before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}
    got = queries.job1_fulltext_index(spark, at)
    assert got.count() > 0 and {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")} == before

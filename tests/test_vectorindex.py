"""The inverted-file index of vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.operators import retrieval, vectorindex

CHUNKS = "version_id string, chunk_id long, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    """Two versions of clustered vectors, copies, vectors of length zero and chunks without any."""
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 8))
    rows = [("a" if i % 3 else "b", i, (centers[i % 12] + 0.4 * r.normal(size=8)).tolist()) for i in range(600)]
    rows += [("a", 1000 + i, rows[5][2]) for i in range(40)] + [("b", 2000 + i, [0.0] * 8) for i in range(30)] + [("a", 3000, None), ("c", 4000, rows[0][2]), ("d", 4001, [0.0] * 8)]
    return spark.createDataFrame(rows, CHUNKS).withColumn("list", F.lit("clash")).repartition(3).cache()


@pytest.fixture(scope="module")
def queries(chunks):
    some = chunks.where("(chunk_id % 20 = 0 OR version_id IN ('c', 'd')) AND embedding IS NOT NULL")
    return some.select(F.col("chunk_id").alias("query_id"), "version_id", "embedding").cache()


@pytest.fixture(scope="module")
def index(chunks):
    centroids = vectorindex.fit(chunks, 16)
    return vectorindex.build(chunks, centroids).cache(), centroids


def rows(df):
    return sorted((r.query_id, r.rank0, r.chunk_id, round(r.score, 9)) for r in df.collect())


def test_every_vector_is_on_its_nearest_list(index, chunks):
    built, centroids = index
    got = built.collect()
    assert len(got) == chunks.where("embedding IS NOT NULL").count() and np.allclose(np.linalg.norm(centroids, axis=1), 1)
    for r in got:
        if r.norm == 0:
            assert r.list == -1
        else:
            cos = centroids @ (np.array(r.embedding) / r.norm)
            assert cos[r.list] == pytest.approx(cos.max()) and np.cos(r.gap) == pytest.approx(cos.max(), abs=1e-7)


@pytest.mark.parametrize("ef", [None, 1])
def test_exact_search_is_the_scan(index, chunks, queries, ef):
    assert rows(vectorindex.search_exact(*index, queries, 5, ef=ef)) == rows(retrieval.vector_search(chunks, queries, 5))


def test_exact_search_without_broadcasts(index, chunks, queries, monkeypatch):
    monkeypatch.setattr(vectorindex, "BROADCAST_PROBES", 0)
    assert rows(vectorindex.search_exact(*index, queries, 3, ef=1)) == rows(retrieval.vector_search(chunks, queries, 3))


def test_tuned_search_reaches_its_recall(index, chunks, queries):
    exact = retrieval.vector_search(chunks, queries, 10)
    share = vectorindex.tune(*index, 10)
    assert 0 <= share <= 1
    found = vectorindex.search(*index, queries, 10, share, ef=1)
    assert vectorindex.recall(found, exact, 10).agg(F.avg("recall")).first()[0] >= 0.9
    poor = vectorindex.search(*index, queries, 10, 0.0, ef=1)
    read = vectorindex.reach(*index, queries, 10, 0.0, ef=1)
    assert poor.count() > 0 and read.where("near").count() < read.count()


def test_files_give_the_same_index(spark, index, queries, tmp_path):
    vectorindex.write(*index, str(tmp_path))
    again, centroids = vectorindex.read(spark, str(tmp_path))
    assert np.array_equal(centroids, index[1]) and rows(vectorindex.search(again, centroids, queries, 5)) == rows(vectorindex.search(*index, queries, 5))
    assert len([p for p in (tmp_path / "lists").iterdir() if p.name.startswith("list=")]) == again.select("list").distinct().count()


def test_fit_is_the_same_again(chunks, index):
    assert np.array_equal(vectorindex.fit(chunks, 16), index[1])


def test_empty_tables(spark, index, chunks, queries):
    none = chunks.where("false")
    centroids = vectorindex.fit(none)
    empty = vectorindex.build(none, centroids)
    assert centroids.size == 0 and empty.count() == 0 and vectorindex.search_exact(empty, centroids, queries, 5).count() == 0 and vectorindex.tune(empty, centroids, 5) == 0.0
    assert vectorindex.search(*index, queries.where("false"), 5).count() == 0


def test_zeros_only(spark):
    zeros = spark.createDataFrame([("a", i, [0.0, 0.0]) for i in range(9)], CHUNKS)
    centroids = vectorindex.fit(zeros)
    q = zeros.where("chunk_id = 3").select(F.col("chunk_id").alias("query_id"), "version_id", "embedding")
    assert [r[2] for r in rows(vectorindex.search_exact(vectorindex.build(zeros, centroids), centroids, q, 2))] == [0, 1, 2, 3]


def test_other_dimensions_are_an_error(spark, index):
    bad = spark.createDataFrame([("a", 1, [1.0, 2.0])], CHUNKS)
    with pytest.raises(Exception, match="expected vectors of 8 dimensions"):
        vectorindex.build(bad, index[1]).collect()

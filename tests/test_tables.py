"""Table functions in SQL against the functions on DataFrames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provenant.functions import tables
from provenant.operators import retrieval, tree


def test_walks(spark):
    rows = [(f"n{i}", f"n{i // 2}" if i > 1 else None) for i in range(1, 40)] + [("a", "c"), ("b", "a"), ("c", "b")]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string")
    tables.register_tree(spark, nodes, "test_tree")
    for start in ("n1", "n3", "n39", "a", "none"):
        for name, walk, key in (("descendants", tree.descendants, "root_id"), ("ancestors", tree.ancestors, "start_id")):
            got = sorted((r.node_id, r.depth) for r in spark.sql(f"SELECT * FROM test_tree_{name}('{start}', 7)").collect())
            want = sorted((r.node_id, r.depth) for r in walk(nodes, spark.createDataFrame([(start,)], "node_id string")).drop(key).collect())
            assert got == want, (start, name)
    assert {r.node_id for r in spark.sql("SELECT * FROM test_tree_descendants('n1', 1)").collect()} == {"n1", "n2", "n3"}


def test_walks_may_reach_any_number_of_nodes(spark):
    nodes = spark.range(1, 60).selectExpr("id AS node_id", "CASE WHEN id > 1 THEN id div 2 END AS parent_id")
    tables.register_tree(spark, nodes, "test_bounded")
    row_limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        assert tables.whole(spark, "SELECT * FROM test_bounded_descendants(1L)").count() == 59
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "20"
        with pytest.raises(Exception, match="RECURSION_ROW_LIMIT"):
            spark.sql("SELECT * FROM test_bounded_descendants(1L)").collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", row_limit)


def test_nearest(spark):
    rows = [("v" if i % 4 else "w", i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)] + [("v", 100, [0.0, 0.0, 0.0]), ("v", 101, None)]
    chunks = spark.createDataFrame(rows, "version_id string, chunk_id long, embedding array<float>")
    tables.register_vectors(spark, chunks, "test_top_k")
    for version, query in (("v", [1.0, 2.0, 0.5]), ("w", [0.0, 0.0, 0.0]), ("x", [1.0, 1.0, 1.0])):
        asked = spark.createDataFrame([(1, version, query)], "query_id int, version_id string, embedding array<double>")
        want = [(r.chunk_id, pytest.approx(r.score)) for r in retrieval.vector_search(chunks, asked, 5).where("rank0 < 6").orderBy("rank0").collect()]
        literal = f"array({', '.join(f'{x}D' for x in query)})"
        got = [(r.chunk_id, r.score) for r in spark.sql(f"SELECT * FROM test_top_k('{version}', {literal}, 6) ORDER BY nth").collect()]
        assert got == want
    joined = spark.sql("SELECT count(*) AS n FROM test_top_k('v', array(1D, 2D, 3D), 10) t JOIN (SELECT 1 AS chunk_id) u USING (chunk_id)")
    assert joined.select(F.col("n")).first()[0] in (0, 1)

"""Table functions of a session: walks over a tree and the nearest vectors, for use in SQL.

They are SQL functions, so Catalyst plans their bodies with the query around them; arguments are literals or variables.  Walks are
recursive and go ``deepest`` steps at most (32 unless told), which also ends cycles.  Spark bounds the rows of a recursion (``spark.sql.cteRecursionRowLimit``, a million);
``whole`` runs a statement without that bound.  Walks from many nodes at once are for ``tree.descendants`` and ``tree.ancestors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import cut

_ROWS = "spark.sql.cteRecursionRowLimit"

_WALK = """CREATE OR REPLACE TEMPORARY FUNCTION {name}(start {kind}, deepest INT DEFAULT 32) RETURNS TABLE(node_id {kind}, depth INT) RETURN
  WITH RECURSIVE walk(node_id, depth) AS (SELECT start, 0 UNION ALL SELECT n.{there}, w.depth + 1 FROM walk w JOIN {nodes} n ON n.{here} = w.node_id AND n.parent_id IS NOT NULL WHERE w.depth < deepest)
  SELECT node_id, CAST({sign} * min(depth) AS INT) FROM walk GROUP BY node_id"""
_DOT = "aggregate(zip_with({a}, {b}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE)), 0D, (s, v) -> s + v)"


def register_tree(spark: SparkSession, nodes: DataFrame, prefix: str = "tree") -> None:
    """``<prefix>_descendants(start, deepest)`` and ``<prefix>_ancestors(start, deepest)``: node_id and depth (0 for the start, negative above), over (node_id, parent_id)."""
    view, kind = f"{prefix}_nodes", nodes.schema["node_id"].dataType.simpleString()
    nodes.select("node_id", "parent_id").createOrReplaceTempView(view)
    for name, here, there, sign in (("descendants", "parent_id", "node_id", 1), ("ancestors", "node_id", "parent_id", -1)):
        spark.sql(_WALK.format(name=f"{prefix}_{name}", kind=kind, nodes=view, here=here, there=there, sign=sign))


def whole(spark: SparkSession, statement: str) -> DataFrame:
    """The rows of a statement whose walks may reach any number of nodes, cut into the shared folder: the bound is read when rows are made, and holds again afterwards."""
    bound = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, -1)
    try:
        return cut(spark.sql(statement))
    finally:
        spark.conf.set(_ROWS, bound)


def register_vectors(spark: SparkSession, chunks: DataFrame, name: str = "vector_top_k") -> None:
    """``<name>(version, query, k)``: chunk_id, score (cosine, 0 for a vector of length zero) and nth of the nearest k chunks of a version, ties by id."""
    view, kind, version = f"{name}_chunks", chunks.schema["chunk_id"].dataType.simpleString(), chunks.schema["version_id"].dataType.simpleString()
    chunks.where("embedding IS NOT NULL").select("version_id", "chunk_id", "embedding").createOrReplaceTempView(view)
    size = f"sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='query', b='query')})"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(version {version}, query ARRAY<DOUBLE>, k INT) RETURNS TABLE(chunk_id {kind}, score DOUBLE, nth INT) RETURN
          SELECT chunk_id, score, nth FROM (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS nth FROM (
            SELECT chunk_id, CASE WHEN {size} = 0 THEN 0D ELSE {_DOT.format(a='embedding', b='query')} / ({size}) END AS score FROM {view} WHERE version_id = version)) WHERE nth <= k"""
    )

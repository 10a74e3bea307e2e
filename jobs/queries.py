"""The jobs as registered queries: each runs its job twice into one fresh folder and returns what is there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import fulltext_index, retrieval_report
from jobs.common import settings
from provenant.functions.shared import scratch
from provenant.plans.queries import KEYWORD_RANKS, VECTOR_RANKS, fused_sql


def job1_fulltext_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text index of all documents, after a second run that has nothing new to take."""
    at, config = scratch(spark, "job1"), settings("fulltext_index")
    for _ in range(2):
        fulltext_index.run(spark, f"{sf_dir}/documents.parquet", f"{at}/output", f"{at}/checkpoint", config)
    return fulltext_index.current(spark, f"{at}/output").select("version_id", "lexeme", "chunk_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every question under each way of retrieving."""
    at, config = scratch(spark, "job2"), settings("retrieval_report")
    for _ in range(2):
        retrieval_report.run(spark, *(f"{sf_dir}/{name}.parquet" for name in ("documents", "embeddings", "labels")), at, config)
    each = retrieval_report.table(spark, at, "per_query", config)
    return each.select("method", "query_id", *(F.round(c, 6).alias(c) for c, kind in each.dtypes if kind == "double"))


INDEX_SQL = r"""SELECT version_id, lexeme, chunk_id, string_agg(place, ',' ORDER BY place) AS positions FROM (SELECT version_id, chunk_id, unnest(words) AS lexeme, generate_subscripts(words, 1) - 1 AS place
  FROM (SELECT lang AS version_id, doc_id::VARCHAR AS chunk_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS words FROM documents)) GROUP BY ALL"""

#: The metrics of the report from its pool, for the cuts of its config.
_KS, _LEAST = (1, 3, 5), 2
_AT = ", ".join(
    f"round(CASE WHEN relevant > 0 THEN coalesce(hits_{k}, 0) / relevant ELSE 0 END, 6)::DOUBLE AS recall_at_{k}, round(coalesce(hits_{k}, 0) / {k}, 6)::DOUBLE AS precision_at_{k}, round(CASE WHEN idcg_{k} > 0 THEN coalesce(dcg_{k}, 0) / idcg_{k} ELSE 0 END, 6)::DOUBLE AS ndcg_at_{k}"
    for k in _KS
)
_SUMS = lambda rank, of: ", ".join(f"sum((pow(2, relevance) - 1) / log2({rank} + 1)) FILTER (WHERE {rank} <= {k}) AS {of}_{k}" for k in _KS)
_HITS = ", ".join(f"count(*) FILTER (WHERE relevance >= {_LEAST} AND rank <= {k}) AS hits_{k}" for k in _KS)
REPORT_SQL = f"""WITH found AS (SELECT 'vector' AS method, query_id, chunk_id, rank0 + 1 AS rank FROM {VECTOR_RANKS} WHERE rank0 < 10 UNION ALL SELECT 'keyword', query_id, chunk_id, rank0 + 1 FROM {KEYWORD_RANKS} WHERE rank0 < 10
    UNION ALL SELECT 'hybrid', query_id, chunk_id, rank0 + 1 FROM {fused_sql(VECTOR_RANKS, KEYWORD_RANKS)} WHERE rank0 < 10),
  judged AS (SELECT f.*, CASE WHEN q.label = c.label AND good = 1 THEN 3 WHEN q.label = c.label THEN 2 WHEN good = 1 THEN 1 ELSE 0 END AS relevance FROM found f JOIN embeddings q ON q.vec_id = f.query_id LEFT JOIN embeddings c ON c.vec_id = f.chunk_id
    LEFT JOIN (SELECT doc_id, max(quality) AS good FROM labels GROUP BY 1) g ON g.doc_id = f.chunk_id),
  pool AS (SELECT query_id, chunk_id, max(relevance) AS relevance FROM judged GROUP BY ALL),
  ideal AS (SELECT query_id, count(*) FILTER (WHERE relevance >= {_LEAST}) AS relevant, {_SUMS('r', 'idcg')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS r FROM pool) GROUP BY 1),
  got AS (SELECT method, query_id, min(rank) FILTER (WHERE relevance >= {_LEAST}) AS first, {_HITS}, {_SUMS('rank', 'dcg')} FROM judged GROUP BY ALL)
  SELECT m.method, i.query_id, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, {_AT} FROM (SELECT DISTINCT method FROM found) m CROSS JOIN ideal i LEFT JOIN got g ON g.method = m.method AND g.query_id = i.query_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_fulltext_index, job2_retrieval_report)}
SQL = {name: " ".join(sql.split()) for name, sql in (("job1_fulltext_index", INDEX_SQL), ("job2_retrieval_report", REPORT_SQL))}

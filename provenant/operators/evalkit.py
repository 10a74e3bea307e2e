"""Evaluation: judgments, ranking metrics, thresholds and run differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def map_qrels(qrels: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id and relevance: judgments by source id brought to chunks; of duplicates the greatest relevance; unresolved ones have no chunk_id."""
    ids = chunks.select("version_id", "source_id", "chunk_id")
    found = qrels.join(ids, ["version_id", "source_id"], "left")
    return found.groupBy("query_id", "version_id", "source_id", "chunk_id").agg(F.max("relevance").alias("relevance"))


def metrics(results: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5), least: int = 2) -> DataFrame:
    """method, query_id, mrr, and recall, precision and nDCG at each k.

    ``results``: method, query_id, chunk_id, rank (from 1); ``qrels``: query_id, chunk_id, relevance.  Queries without judgments have no row.
    """
    methods = [r["method"] for r in results.select("method").distinct().collect()]  # a handful
    q = qrels.where("chunk_id IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), F.col("chunk_id")))
    gain = (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("rank") + 1.0)
    ideal = q.withColumn("rank", ideal_rank).groupBy("query_id").agg(F.count_if(F.col("relevance") >= least).alias("relevant"), *(F.sum(F.when(F.col("rank") <= k, gain)).alias(f"idcg_{k}") for k in ks))
    judged = results.join(q, ["query_id", "chunk_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    hit = F.col("relevance") >= least
    got = judged.groupBy("method", "query_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"), *(F.count_if(hit & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks), *(F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg_{k}") for k in ks)
    )
    both = ideal.withColumn("method", F.explode(F.array(*map(F.lit, sorted(methods))))).join(got, ["method", "query_id"], "left")
    cols = [F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        hits = F.coalesce(f"hits_{k}", F.lit(0))
        cols += [
            F.when(F.col("relevant") > 0, hits / F.col("relevant")).otherwise(0.0).alias(f"recall_at_{k}"),
            (hits / k).alias(f"precision_at_{k}"),
            F.when(F.col(f"idcg_{k}") > 0, F.coalesce(f"dcg_{k}", F.lit(0.0)) / F.col(f"idcg_{k}")).otherwise(0.0).alias(f"ndcg_at_{k}"),
        ]
    return both.select("method", "query_id", *cols)


def mean_metrics(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Means of all metrics by the given columns, and the number of queries."""
    names = [c for c, kind in per_query.dtypes if kind == "double"]
    return per_query.groupBy(*by).agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in names))


def macro_mean(per_query: DataFrame, scenario: str, by: list[str]) -> DataFrame:
    """The mean over scenarios of their means."""
    names = [c for c, kind in per_query.dtypes if kind == "double"]
    return mean_metrics(per_query, [scenario, *by]).groupBy(*by).agg(*(F.avg(c).alias(c) for c in names))


def violations(summary: DataFrame, thresholds: DataFrame) -> DataFrame:
    """method, metric, actual and minimum where a metric (0 if it is missing) stays below its minimum."""
    both = thresholds.join(summary.select("method", "metric", F.col("value").alias("actual")), ["method", "metric"], "left")
    return both.withColumn("actual", F.coalesce("actual", F.lit(0.0))).where("actual < minimum").select("method", "metric", "actual", "minimum")


def long_form(summary: DataFrame, by: list[str]) -> DataFrame:
    """Metrics as rows: the keys, metric and value."""
    names = [c for c, kind in summary.dtypes if kind == "double" and c not in by]
    return summary.unpivot(by, names, "metric", "value")


def run_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """dimension and the score's change (four places) of dimensions that both runs have."""
    b, c = baseline.select("dimension", F.col("score").alias("baseline")), candidate.select("dimension", F.col("score").alias("candidate"))
    return b.join(c, "dimension").select("dimension", "baseline", "candidate", F.round(F.col("candidate") - F.col("baseline"), 4).alias("delta"))


def warning_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """warning and whether it was added or removed."""
    b, c = baseline.select("warning").distinct(), candidate.select("warning").distinct()
    return c.join(b, "warning", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(c, "warning", "left_anti").withColumn("change", F.lit("removed")))


def backend_violations(summaries: DataFrame, allowed: tuple[str, ...] = ("completed",), least_citations: int = 1, least_coverage: float = 0.5, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """backend and check of each rule that a backend's summary (backend, status, citations, coverage, score, warnings) breaks, hybrid lying between the others included."""
    own = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("status").isin(*allowed), F.lit(False)), F.lit("status")),
            F.when(F.coalesce("citations", F.lit(0)) < least_citations, F.lit("citations")),
            F.when(F.coalesce("coverage", F.lit(0.0)) < least_coverage, F.lit("coverage")),
            F.when(F.arrays_overlap("warnings", F.array(*map(F.lit, forbidden)).cast("array<string>")), F.lit("forbidden_warning")) if forbidden else F.lit(None).cast("string"),
        )
    )
    broken = summaries.select("backend", F.explode(own).alias("check"))
    one = lambda b: F.max(F.when(F.col("backend") == b, F.col("score")))
    relation = summaries.agg(one("analyzer").alias("a"), one("agent-mcp").alias("g"), one("hybrid").alias("h")).where("h < least(a, g) OR h > greatest(a, g)").select(F.lit("hybrid").alias("backend"), F.lit("between").alias("check"))
    return broken.unionByName(relation)

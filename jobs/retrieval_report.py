"""Report how well each way of retrieving finds what was judged relevant, and which thresholds it misses.

Questions are the vectors whose id is divisible by ``every``, each asked of the documents of its own document's language, with
keywords that go round by the id.  Every question is answered by each of ``modes`` over all documents; the answers of all modes
together are its pool, and only pooled documents are judged: 3 if the document is of the question's topic and marked as of good
quality, 2 if it is of its topic, 1 if it is only marked good, else 0.  Recall is relative to the pool.

Three tables are written, partitioned by method, each over what an earlier run left: ``answers``, ``per_query``, and
``violations`` of the means that are below their thresholds.  A run over the same tables gives the same rows.

    python -m jobs.retrieval_report --documents PATH --embeddings PATH --labels PATH --output PATH [--config FILE]

Defined cases: documents without a vector are found by keywords only; null texts match nothing; of several marks of a document
the best counts; a mode that answers nothing has metrics of zero for every question with a pool; questions without
any answer have no row; extra columns are ignored; empty tables give empty ones.
"""

from __future__ import annotations

import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, log, main
from provenant.operators import evalkit, retrieval

FOLDERS = ["documents", "embeddings", "labels", "output"]


def questions(docs: DataFrame, vectors: DataFrame, config: dict[str, Any]) -> DataFrame:
    """query_id, version_id, embedding, topic, keywords and query of every question."""
    listed = F.array(*(F.array(*map(F.lit, words)) for words in config["keywords"]))
    turn = (F.floor(F.col("vec_id") / config["every"]) % len(config["keywords"]) + 1).cast("int")
    asked = vectors.where(F.col("vec_id") % config["every"] == 0).join(docs.select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("version_id")), "vec_id")
    return asked.select(F.col("vec_id").alias("query_id"), "version_id", "embedding", F.col("label").alias("topic"), F.element_at(listed, turn).alias("keywords")).withColumn("query", F.concat_ws(" ", "keywords"))


def answers(docs: DataFrame, vectors: DataFrame, asked: DataFrame, config: dict[str, Any]) -> DataFrame:
    """method, query_id, chunk_id, rank (from 1) and score of the best ``top_k`` of every mode."""
    chunks = docs.select(F.col("lang").alias("version_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("text_raw")).join(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    out = None
    for mode in config["modes"]:
        one = retrieval.ranked(chunks, asked, config["top_k"], mode).select(F.lit(mode).alias("method"), "query_id", "chunk_id", (F.col("rank0") + 1).alias("rank"), "score")
        out = one if out is None else out.unionByName(one)
    return out


def judged(found: DataFrame, asked: DataFrame, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """The answers with their relevance."""
    good = labels.groupBy(F.col("doc_id").alias("chunk_id")).agg(F.max("quality").alias("quality"))
    topics = found.join(asked.select("query_id", "topic"), "query_id").join(vectors.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("own_topic")), "chunk_id", "left").join(good, "chunk_id", "left")
    same, fine = F.coalesce(F.col("topic") == F.col("own_topic"), F.lit(False)), F.coalesce(F.col("quality") == 1, F.lit(False))
    return topics.select("query_id", "chunk_id", "rank", "score", F.when(same & fine, 3).when(same, 2).when(fine, 1).otherwise(0).alias("relevance"), "method")


def thresholds(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """method, metric and minimum of the thresholds of the modes that run."""
    rows = [(method, metric, float(least)) for method, own in config["thresholds"].items() if method in config["modes"] for metric, least in own.items()]
    return spark.createDataFrame(rows, "method string, metric string, minimum double")


def schemas(config: dict[str, Any]) -> dict[str, str]:
    """The tables that are written, with their partitions' column last."""
    names = ["mrr", *(f"{m}_at_{k}" for k in config["ks"] for m in ("recall", "precision", "ndcg"))]
    return {
        "answers": "query_id long, chunk_id long, rank int, score double, relevance int, method string",
        "per_query": f"query_id long, {', '.join(f'{n} double' for n in names)}, method string",
        "violations": "metric string, actual double, minimum double, method string",
    }


def table(spark: SparkSession, output: str, name: str, config: dict[str, Any]) -> DataFrame:
    """One of the tables, of the methods of this config."""
    return spark.read.schema(schemas(config)[name]).parquet(f"{output}/{name}").where(F.col("method").isin(config["modes"]))


def run(spark: SparkSession, documents: str, embeddings: str, labels: str, output: str, config: dict[str, Any]) -> dict[str, Any]:
    """Write the three tables below ``output``; returns what was read and written, and how many thresholds are missed."""
    docs, vectors, marks = (spark.read.parquet(p) for p in (documents, embeddings, labels))
    report = {name: counted(p, df) for name, p, df in (("documents", documents, docs), ("embeddings", embeddings, vectors), ("labels", labels, marks))}

    def put(name: str, rows: DataFrame) -> DataFrame:
        columns = [c.split() for c in schemas(config)[name].split(", ")]
        # a method without rows now loses those of an earlier run too
        rows.select(*(F.col(c).cast(kind) for c, kind in columns)).write.mode("overwrite").partitionBy("method").parquet(f"{output}/{name}")
        done = table(spark, output, name, config)
        report[name] = counted(f"{output}/{name}", done)
        return done

    asked = questions(docs, vectors, config)
    found = put("answers", judged(answers(docs, vectors, asked, config), asked, vectors, marks))
    pool = found.groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    each = put("per_query", evalkit.metrics(found.select("method", "query_id", "chunk_id", "rank"), pool, tuple(config["ks"]), config["least"]))
    means = evalkit.long_form(evalkit.mean_metrics(each, ["method"]).drop("queries"), ["method"])
    missed = put("violations", evalkit.violations(means, thresholds(spark, config)))
    for r in missed.collect():  # a row for each threshold at most
        log.info("%s: %s is %.4f, below %.4f", r["method"], r["metric"], r["actual"], r["minimum"])
    return report


if __name__ == "__main__":
    sys.exit(main("retrieval_report", run, FOLDERS))

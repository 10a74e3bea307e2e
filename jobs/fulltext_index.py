"""Keep a full-text index of a growing folder of documents: every run takes the files that are new.

A file stream drained with ``availableNow`` hands over new files in batches; its checkpoint is the mark of what was taken.
Each batch writes two tables, partitioned by batch and version, of its own documents only:

- ``chunks``: chunk_id, text_hash and n_words of every document;
- ``postings``: lexeme, chunk_id and positions of every word of it (``fulltext.postings``).

A batch that runs again after a failure overwrites its own partitions with the same rows and touches no other.  A document
that comes again in a later batch supersedes its earlier rows: ``current`` gives each document as its last batch had it.
Output and checkpoint belong together; a new checkpoint needs a new output.

    python -m jobs.fulltext_index --documents PATH --output PATH --checkpoint PATH [--config FILE]

Ids and versions are kept as strings.  Defined cases: a null text has no words, but a row among the chunks; of rows with one id in a batch the greatest version and text stays; rows
without an id cannot be found again and are counted in the report only; empty files make an empty index; extra columns are ignored.
"""

from __future__ import annotations

import sys
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from jobs.common import counted, log, main
from provenant.functions.text import text_hash
from provenant.operators import fulltext
from provenant.operators.retrieval import tokens

#: Both tables, with their partitions' columns last.
TABLES = {"chunks": "chunk_id string, text_hash string, n_words int, batch int, version_id string", "postings": "lexeme string, chunk_id string, positions array<int>, batch int, version_id string"}
FOLDERS = ["documents", "output", "checkpoint"]
#: Up to so many ids (repeated in a batch, superseded) are broadcast; beyond, texts or postings are shuffled by id.
BROADCAST_IDS = 200_000
CONCURRENT, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", "16"


def write(rows: DataFrame, path: str) -> None:
    """Rows of a batch, over whatever an earlier try of the same batch left there; up to ``WRITERS`` versions of a task are written side by side, as a sort of all postings would spill many times the texts."""
    conf = rows.sparkSession.conf
    before = conf.get(CONCURRENT)
    conf.set(CONCURRENT, WRITERS)
    try:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "version_id").parquet(path)
    finally:
        conf.set(CONCURRENT, before)


def once(named: DataFrame, repeated: int) -> DataFrame:
    """One row of each id, that of the greatest version and text; only texts of the ``repeated`` ids are shuffled, while these are few."""
    greatest = lambda df: df.groupBy("chunk_id").agg(F.max(F.struct("version_id", "text_raw")).alias("x")).select("chunk_id", "x.*")
    known = named.where("chunk_id IS NOT NULL").select("chunk_id", "version_id", "text_raw")
    if not repeated:
        return known
    if repeated > BROADCAST_IDS:
        return greatest(known)
    again = F.broadcast(known.groupBy("chunk_id").count().where("count > 1").select("chunk_id"))
    return known.join(again, "chunk_id", "left_anti").unionByName(greatest(known.join(again, "chunk_id", "left_semi")))


def index(docs: DataFrame, batch: int, output: str, config: dict[str, Any], taken: list[Row]) -> None:
    """Write both tables of a batch of documents; its counts join ``taken``."""
    named = docs.select(F.col(config["version"]).cast("string").alias("version_id"), F.col(config["id"]).cast("string").alias("chunk_id"), F.col(config["text"]).alias("text_raw"))
    no_id = F.col("chunk_id").isNull()
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    seen = named.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(total("n").alias("rows"), total(F.when(no_id, F.col("n"))).alias("without_id"), F.count_if(~no_id & (F.col("n") > 1)).alias("repeated")).first()
    each, at = once(named, seen["repeated"]), F.lit(batch).alias("batch")
    write(each.select("version_id", "chunk_id", text_hash("text_raw").alias("text_hash"), F.size(tokens(F.coalesce("text_raw", F.lit("")))).alias("n_words"), at), f"{output}/chunks")
    write(fulltext.postings(each).select("version_id", "lexeme", "chunk_id", "positions", at), f"{output}/postings")
    taken.append(Row(rows=seen["rows"], without_id=seen["without_id"]))
    log.info("batch %d: read %d rows, %d of them without an id; written to %s", batch, taken[-1]["rows"], taken[-1]["without_id"], output)


def pattern(path: str) -> str:
    """A path as a pattern that it alone matches: a file stream takes folders and patterns, and a table may be one file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict[str, Any]) -> dict[str, Any]:
    """Index the files below ``documents`` that no earlier run with this checkpoint took; returns what was read and what there is now."""
    taken: list[Row] = []
    source = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(pattern(documents))
    query = source.writeStream.foreachBatch(lambda df, n: index(df, n, output, config, taken)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches of new files", documents, len(taken))
    there = {name: counted(f"{output}/{name}", table(spark, output, name)) for name in TABLES}
    return {"batches": len(taken), "rows_read": sum(r["rows"] for r in taken), "without_id": sum(r["without_id"] for r in taken), **there}


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """One of the two tables, as all batches left it."""
    return spark.read.schema(TABLES[name]).parquet(f"{output}/{name}")


def superseded(chunks: DataFrame) -> DataFrame:
    """chunk_id and batch of the rows of documents that came again in a later batch."""
    again = chunks.groupBy("chunk_id").agg(F.collect_set("batch").alias("batches")).where("size(batches) > 1")
    return again.select("chunk_id", F.explode(F.expr("filter(batches, b -> b < array_max(batches))")).alias("batch"))


def current(spark: SparkSession, output: str) -> DataFrame:
    """version_id, lexeme, chunk_id and positions, each document as its last batch had it; a job counts the superseded rows while the plan is made, and few of them cost no exchange of the postings."""
    gone = superseded(table(spark, output, "chunks"))
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return table(spark, output, "postings").join(gone, ["chunk_id", "batch"], "left_anti").select("version_id", "lexeme", "chunk_id", "positions")


if __name__ == "__main__":
    sys.exit(main("fulltext_index", run, FOLDERS))

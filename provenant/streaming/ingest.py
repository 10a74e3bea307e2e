"""Continuous ingest: new content lists become keyed upserts of all layers.

A file source drained with ``availableNow`` stands for a polled work queue; its checkpoint is the status of every file.
Ids and hashes are deterministic, so a batch that runs twice changes nothing.  A batch rewrites the partitions of its own versions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, sinks
from ..sources.content import items_of

#: Keys of the layers.
KEYS = {"pages": ["version_id", "page_idx"], "units": ["version_id", "unit_id"], "chunks": ["version_id", "chunk_id"], "spans": ["version_id", "chunk_id", "unit_order"]}
#: Partitions of a table.
BUCKETS = 64


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def bucket() -> Column:
    """The folder of a version's rows within a table."""
    return F.pmod(F.xxhash64("version_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def apply(spark: SparkSession, items: DataFrame, out: str) -> None:
    """Put the layers of the items into the tables below ``out``; versions that come again are replaced whole.

    Tables are partitioned by a hash of the version, and only the partitions that the items touch are read and written again.
    """
    layers = ingest.ingest(items)
    versions = items.select("version_id").distinct()
    touched = [r["bucket"] for r in versions.select(bucket()).distinct().collect()]  # at most BUCKETS
    for name, key in KEYS.items():
        new, at = getattr(layers, name), f"{out}/{name}"
        if exists(spark, at):
            old = spark.read.parquet(at).where(F.col("bucket").isin(touched)).drop("bucket")
            new = sinks.upsert(old, new, key, coalesce=True) if name == "pages" else sinks.delete_matching(old, versions, ["version_id"]).unionByName(new)
        new.withColumn("bucket", bucket()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(at)


def stream(spark: SparkSession, source: str, out: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None):
    """Ingest all content lists that are new below ``source``, and stop; returns the finished query."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(source).select(F.col("_metadata.file_path").alias("version_id"), F.col("value").alias("content"))

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        items = items_of(df)
        apply(df.sparkSession, items, out)
        if after:
            after(items)

    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

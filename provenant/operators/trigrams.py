"""Substring search by an index of trigrams.

The index has a row for each run of three code points of a chunk's lower-cased text: version_id, gram, chunk_id.  A keyword of three
code points or more can occur only where all its trigrams do; the rarest ``RAREST`` of them choose candidates, whose texts then decide,
so the result is that of ``lower(text) LIKE '%keyword%'`` over every chunk.  Shorter keywords have no trigram and are looked for in all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from .retrieval import answered, asked_once, best, meet

#: Trigrams of a keyword that choose its candidates.
RAREST = 3
#: Up to so many keywords are broadcast to the index (a few short strings each); beyond, both are shuffled.
BROADCAST_KEYS = 5_000


def grams(text: Column | str) -> Column:
    """The distinct trigrams of a text, lower-cased; none of fewer than three code points or a null text; told in Arrow batches."""

    def told(texts: pa.Array) -> pa.Array:
        runs = []
        for t in texts.to_pylist():
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            packed, first = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_index=True)
            runs.append(packed[np.argsort(first)])
        every, code = np.unique(np.concatenate(runs) if runs else np.zeros(0, np.int64), return_inverse=True)
        names = pa.array(["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in every.tolist()], pa.string())
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(code.reshape(-1))))

    told.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(told, "array<string>")(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def index(chunks: DataFrame) -> DataFrame:
    """version_id, gram and chunk_id of every trigram of every chunk; no exchange, as a chunk's trigrams are told apart in its own row."""
    return chunks.select("version_id", F.explode(grams("text_raw")).alias("gram"), "chunk_id")


def found(held: DataFrame, chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """version_id, key and chunk_id wherever a key of (version_id, key; lower-cased, distinct) occurs; a job counts the keys while the plan is made."""
    few = (lambda df: F.broadcast(df)) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else (lambda df: df)
    texts = chunks.select("version_id", "chunk_id", F.lower("text_raw").alias("low"))
    short = keys.where("length(key) < 3").groupBy("version_id").agg(F.collect_list("key").alias("keys"))
    scanned = meet(texts, short).select("version_id", F.explode(F.filter("keys", lambda k: F.contains(F.col("low"), k))).alias("key"), "chunk_id")
    wanted = keys.where("length(key) >= 3").select("version_id", "key", F.explode(grams("key")).alias("gram"))
    # the index may be a plan over all texts: its rows of wanted trigrams are read twice, so they are cut
    held = cut(held.join(few(wanted.select("version_id", "gram").distinct()), ["version_id", "gram"], "left_semi"))
    sizes = held.groupBy("version_id", "gram").agg(F.count("*").alias("chunks"))
    # a trigram that no chunk has leaves its key without candidates
    rare = Window.partitionBy("version_id", "key").orderBy(F.coalesce("chunks", F.lit(0)), "gram")
    chosen = wanted.join(sizes, ["version_id", "gram"], "left").withColumn("nth", F.row_number().over(rare)).where(F.col("nth") <= RAREST)
    chosen = chosen.withColumn("of", F.count("*").over(Window.partitionBy("version_id", "key"))).select("version_id", "key", "gram", "of")
    near = held.join(few(chosen), ["version_id", "gram"]).groupBy("version_id", "key", "chunk_id").agg(F.count("*").alias("n"), F.max("of").alias("of")).where("n = of").select("version_id", "key", "chunk_id")
    sure = near.join(texts, ["version_id", "chunk_id"]).where(F.contains("low", "key")).select("version_id", "key", "chunk_id")
    return scanned.unionByName(sure)


def ilike_any(held: DataFrame, chunks: DataFrame, keywords: list[str]) -> DataFrame:
    """The chunks in which any keyword occurs, in either case."""
    listed = sorted({k.lower() for k in keywords})
    keys = chunks.select("version_id").distinct().select("version_id", F.explode(F.array(*map(F.lit, listed)).cast("array<string>")).alias("key"))
    return chunks.join(found(held, chunks, keys).select("version_id", "chunk_id").distinct(), ["version_id", "chunk_id"], "left_semi")


def substring_search(held: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """The rows of ``retrieval.substring_search``: query_id, chunk_id, score (how many of the query's keywords occur) and rank0."""
    once, asking = asked_once(queries, "keywords")
    asked = once.select("query_id", "version_id", F.explode("keywords").alias("key")).select("query_id", "version_id", F.lower("key").alias("key")).groupBy("query_id", "version_id", "key").agg(F.count("*").alias("times"))
    hits = found(held, chunks, asked.select("version_id", "key").distinct()).join(asked, ["version_id", "key"])
    return answered(best(hits.groupBy("query_id", "chunk_id").agg(F.sum("times").cast("double").alias("score")), top_k), asking)

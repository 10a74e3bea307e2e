"""Importance resampling of documents towards a target distribution, by hashed features.

Features of a text are its runs of one to ``n`` consecutive words, joined by a space; the bucket of a feature is its CRC-32
modulo ``buckets``.  One scan over a document's words keeps a ring of running zlib states, one for each of the last ``n``
starts: a word extends every state in the ring by a space and itself and opens a new one, and each state then is the CRC-32
of the run from its start to this word.  No feature is ever put together.

The scan's buckets are written to the shared folder once, two bytes each; counts over the corpus and the weights of the
documents are made from them.  A bucket's gain compares its smoothed share in the target with that in the corpus; a
document's weight is the floored mean of its features' gains.  With a Gumbel variate from a hash of its id added, the
documents of greatest score are a draw without replacement in proportion to exp(weight / 1000).

Defined cases: a null text has no words, and a text without words no features and weight 0; texts of any length are scanned whole;
a null id hashes as an empty one and comes last among equal scores; repeated rows are documents of their own, equal scores go
by id, weight and features; an empty corpus gives an empty table; with an empty target all gains come from smoothing; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import global_rank
from .common import scratch, tidy

WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Bytes of text, and values, that are held at once.
CHUNK = 4_000_000

#: ASCII letters in lower case, what is neither letter nor digit as a blank.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def scan(text: bytes, n: int = WORDS, buckets: int = BUCKETS) -> tuple[int, list[int]]:
    """The number of words of a text and the bucket of each of its features."""
    words = text.translate(_LOWER).split()
    ring: list[int] = []  # the states of the last starts, the oldest first
    out: list[int] = []
    keep = 1 - n if n > 1 else None
    for word in words:
        piece = b" " + word
        ring = [crc32(piece, state) for state in (ring[keep:] if keep else ())]
        ring.append(crc32(word))
        out += ring
    return len(words), [state % buckets for state in out]


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features and found (the buckets, sorted, as little-endian bytes) of every row."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_words", "n_features", "found"]

        def rows(ids: pa.Array, got: list[tuple[int, bytes]]) -> pa.RecordBatch:
            size = np.dtype(kind).itemsize
            return pa.RecordBatch.from_arrays([ids, pa.array([w for w, _ in got], pa.int64()), pa.array([len(f) // size for _, f in got], pa.int64()), pa.array([f for _, f in got], pa.binary())], names)

        for batch in batches:
            got, first, held = [], 0, 0
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                words, found = scan(t.as_py() or b"", n, buckets)
                got.append((words, np.sort(np.array(found, kind)).tobytes()))
                held += len(got[-1][1])
                if held >= CHUNK:
                    yield rows(batch.column(0).slice(first, len(got)), got)
                    got, first, held = [], i + 1, 0
            if got:
                yield rows(batch.column(0).slice(first, len(got)), got)
        tidy()

    return docs.select(id_col, text).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, found binary")


def counted(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in ``found``; every task sends a row for each bucket at most."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier each bucket is in the target, floored; every bucket counts once more than it occurs."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight of every row: the floored mean of its features' gains."""
    kind, table = _kind(len(gain)), found.sparkSession.sparkContext.broadcast(gain)  # a long for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for x in batch.column(3):
                mine = np.frombuffer(x.as_py(), kind)
                weights.append(int(table.value[mine].sum()) // len(mine) if len(mine) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["id", "n_words", "n_features", "weight"])

    kind_of_id = found.schema["id"].dataType.simpleString()
    return found.select("id", "n_words", "n_features", "found").mapInArrow(run, f"id {kind_of_id}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_id: str = "item_id", target_text: str = "text",
    n: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``id_col``, n_features, weight, score and rank (1, 2, ... of the drawn, by score; null of all others) of every document."""
    spark = docs.sparkSession
    at = scratch(spark, "resample")
    scanned(docs, id_col, text, n, buckets).write.parquet(at)
    found = spark.read.parquet(at)
    gain = gains(counted(found, buckets), counted(scanned(target, target_id, target_text, n, buckets), buckets))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(found, gain).withColumn("score", (F.col("weight") + gumbel).cast("long"))
    able = F.col("n_words") >= least_words
    order = [able.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features")]
    ranked = global_rank(scored, order, "place")
    draw = ranked.where(able).count() * percent // 100
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("place") <= draw, F.col("place")).alias("rank"))

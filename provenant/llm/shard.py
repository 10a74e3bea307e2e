"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id, row number), so equal texts stand together and yet any
group can be split.  The splitters between shards are found by counting: each round counts, over all
partitions, the exact bytes and rows between candidate boundaries (at most ``PROBES`` for each open
splitter), narrows every splitter to the two boundaries around its goal and probes there again, until
the bytes below it are within ``TOLERANCE`` of a shard's share or no boundary lies between.  Then rows
are exchanged once and numbered.

To number a shard without sorting it in one task, its rows are dealt by the id's hash to as many pieces as
its size asks for; the pieces' row counts give each its first slot.

Law: ``bytes``.  A row's size is its text's UTF-8 bytes plus one.

Defined cases: a null text has size 1 and checksum 0; empty and very long texts are rows like any
other (a single row is never split, so a shard exceeds its share by less than the largest row and the
tolerance); null ids hash alike and are told apart by row number; repeated rows may part at a splitter;
extra columns are ignored; fewer rows than shards leave shards empty; an empty table gives an empty
table.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PROBES, TOLERANCE = 64, 0.0005
#: Rows of a shard that one task sorts and numbers.
PIECE_ROWS = 1_000_000
_KEY = "struct<a: bigint, b: bigint, c: bigint>"
_SPAN = 1 << 64


def _number(key) -> int:
    """A key as one integer, in the order of keys."""
    return ((key["a"] + (_SPAN >> 1)) * _SPAN + key["b"] + (_SPAN >> 1)) * _SPAN + key["c"] + (_SPAN >> 1)


def _key(n: int) -> dict[str, int]:
    n, c = divmod(n, _SPAN)
    a, b = divmod(n, _SPAN)
    return {"a": a - (_SPAN >> 1), "b": b - (_SPAN >> 1), "c": c - (_SPAN >> 1)}


def bucket(boundaries: list[int]) -> Column:
    """How many of the sorted boundaries are at most the row's key: a binary search in an array of them."""
    if not boundaries:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps([_key(b) for b in boundaries])), f"array<{_KEY}>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(boundaries).bit_length()))))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= len(boundaries)) & (F.element_at(array, F.least(at + step, F.lit(len(boundaries)))) <= F.col("key")), at + step).otherwise(at),
    )


def splitters(keyed: DataFrame, shards: int) -> list[int]:
    """The least keys of all shards but the first, as integers: the exact bytes below each are near its share."""
    whole = keyed.agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    if whole["bytes"] is None:
        return []
    total, share = whole["bytes"], whole["bytes"] / shards
    low, high = _number(whole["low"]), _number(whole["high"])
    # of each splitter: the boundaries around its goal, with the exact bytes below each
    around = [[low, 0, high + 1, total] for _ in range(1, shards)]
    while True:
        open_ = [i for i, (a, _, b, _) in enumerate(around) if b - a > 1 and min(abs(x - share * (i + 1)) for x in (around[i][1], around[i][3])) > TOLERANCE * share]
        if not open_:
            break
        probes = sorted({a + (b - a) * k // PROBES for a, _, b, _ in (around[i] for i in open_) for k in range(PROBES + 1)})
        counted = keyed.groupBy(bucket(probes).alias("bucket")).agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        found = {r["bucket"]: r for r in counted.collect()}  # a row for each probe at most
        below, sums = 0, []
        for k in range(len(probes)):
            below += found[k]["bytes"] if k in found else 0
            sums.append(below)
        for i in open_:
            goal = share * (i + 1)
            k = bisect_left(sums, goal, bisect_left(probes, around[i][0]), bisect_left(probes, around[i][2]))
            if k and sums[k - 1] <= goal and k in found:  # the bucket before probe k holds the goal: its own least and greatest keys are tighter
                inside = found[k]
                around[i] = [max(around[i][0], _number(inside["low"])), sums[k - 1], min(probes[k], _number(inside["high"]) + 1), sums[k]]
                if around[i][2] - around[i][0] <= 1:
                    continue
            elif k:
                around[i] = [probes[k - 1], sums[k - 1], probes[k], sums[k]]
    return sorted(a if share * (i + 1) - x <= y - share * (i + 1) else b for i, (a, x, b, y) in enumerate(around))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``bytes``) of every row."""
    sized = docs.select(
        id_col,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("a"),
        F.xxhash64(F.col(id_col).cast("string")).alias("b"),
    )
    # cut: row numbers are drawn once, and texts are read once
    keyed = cut(sized.select(id_col, "size", "text_crc32", F.struct("a", "b", F.monotonically_increasing_id().alias("c")).alias("key")))
    dealt = keyed.withColumn("shard", bucket(splitters(keyed, shards)))
    rows = {r["shard"]: r["n"] for r in dealt.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    most = max([1, *(-(-n // piece_rows) for n in rows.values())])
    piece = F.pmod(F.xxhash64(F.col("key.b"), F.col("key.c")), F.lit(most)).cast("int")
    dealt = dealt.withColumn("piece", piece)
    first: dict[int, list[int]] = {s: [0] * most for s in range(shards)}
    if most > 1:
        counts = {(r["shard"], r["piece"]): r["n"] for r in dealt.groupBy("shard", "piece").agg(F.count("*").alias("n")).collect()}  # a row for each piece
        for s in range(shards):
            for p in range(1, most):
                first[s][p] = first[s][p - 1] + counts.get((s, p - 1), 0)
    offsets = F.from_json(F.lit(json.dumps([x for s in range(shards) for x in first[s]])), "array<bigint>")
    at = F.col("shard") * most + F.col("piece")
    order = F.row_number().over(Window.partitionBy("at").orderBy("key"))
    return dealt.withColumn("at", at).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.element_at(offsets, F.col("at") + 1) + order - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint of 64 bits is cut into 32 segments of two bits.  Its embedding is the vector of the
segments' bit counts; the Manhattan distance of two embeddings never exceeds the Hamming distance
of the fingerprints, so a range-join under Manhattan distance finds every near pair, and an exact
count of differing bits verifies what it finds.  The embedding is kept as one long in which a
count of 0, 1 or 2 is written 00, 01 or 11; the Manhattan distance is then the number of differing
bits of two such longs.

The grid: the 32 dimensions form ``blocks`` runs.  Of two points within Manhattan distance r, at
most r runs differ, so they share a cell of unit width in at least one of the grids that leave out
r runs.  More blocks make cells smaller and grids more; their number follows the count of distinct
fingerprints.  A cell of up to ``CELL`` points is compared inside one array.  The points of larger
cells are linked in another exact way that is linear in their number: two fingerprints differ in at
most two bits exactly when both are within one bit of a common word, and no more than 65 distinct
fingerprints are within one bit of any word.

Copies never multiply: links are between distinct fingerprints, and components (alternating large-
and small-star rounds, cut into the shared folder) are brought back to documents by one join.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like
any other; fewer words than a shingle make one shingle of all words; repeated rows are copies of one
another; null ids come last, and a component of null ids alone has a null component_id; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEGMENTS = 32
LOW = 0x5555555555555555
#: Points of a cell that are compared with one another; larger cells take the other exact way.
CELL = 48
#: A fingerprint with more rows than this, and than a thousandth of all, is joined in so many parts.
CROWD, SALTS = 500, 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a sequence of words: a bit is 1 if it is set in over half the hashes of its shingles."""
    import xxhash

    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fold(hashes: np.ndarray, start: np.ndarray, at_once: int = 1 << 17) -> np.ndarray:
    """The fingerprints of many texts from the 64-bit hashes of their shingles, by text; ``start``: where each text's (one at least) begin."""
    size = np.diff(np.append(start, len(hashes)))
    counts = np.zeros((len(start), 64), np.int64)
    for a in range(0, len(hashes), at_once):
        part = hashes[a : a + at_once]
        first = int(np.searchsorted(start, a, "right")) - 1
        last = int(np.searchsorted(start, a + len(part), "left"))
        bits = np.unpackbits(np.ascontiguousarray(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[first:last] += np.add.reduceat(bits, np.maximum(start[first:last] - a, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``keep`` columns, text_hash and fp (long) of every row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + (", " if keep else "") + "text_hash long, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            fps = [_signed(fingerprint((t.as_py() or b"").lower().split(), shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*keep, "text_hash", "fp"])

    return docs.select(*keep, F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, schema)


def embedding(fp: Column) -> Column:
    """The segment counts of a fingerprint, 0, 1 or 2 written 00, 01 or 11."""
    high = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def blocks_for(n: int, bits: int) -> int:
    """The least number of blocks at which unrelated fingerprints share less than one cell with another, if bits are even."""
    return next((b for b in range(bits + 2, 13) if len(list(combinations(range(b), bits))) * n * 0.375 ** (SEGMENTS * (b - bits) / b) <= 1), 12)


def masks(blocks: int, bits: int) -> list[int]:
    """The bits of an embedding that each grid looks at."""
    edge = [round(i * SEGMENTS / blocks) for i in range(blocks + 1)]
    of = [sum(3 << (2 * s) for s in range(edge[i], edge[i + 1])) for i in range(blocks)]
    return [_signed(sum(of[i] for i in range(blocks) if i not in out)) for out in combinations(range(blocks), bits)]


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a < b) between distinct fingerprints ``fp`` that join all that differ in at most ``bits`` bits; pairs in crowded cells may be linked through a third."""
    if bits not in (1, 2):
        raise ValueError("bits is 1 or 2")
    grids = masks(blocks_for(distinct.count(), bits), bits)
    points = distinct.select("fp", embedding(F.col("fp")).alias("e"))
    placed = points.select("fp", "e", F.posexplode(F.array(*(F.col("e").bitwiseAND(F.lit(m)) for m in grids))).alias("grid", "cell"))
    crowd = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(placed.join(crowd, ["grid", "cell"]).select("grid", "cell", "n", "fp", "e"))
    pairs = F.expr(
        f"""flatten(transform(points, (p, i) -> transform(
              filter(slice(points, i + 2, {CELL}), q -> bit_count(p.e ^ q.e) <= {bits} AND bit_count(p.fp ^ q.fp) <= {bits}),
              q -> struct(least(p.fp, q.fp) AS a, greatest(p.fp, q.fp) AS b))))"""
    )
    near = shared.where(F.col("n") <= CELL).groupBy("grid", "cell").agg(F.collect_list(F.struct("fp", "e")).alias("points")).select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    if bits == 1:  # words are the members without one of their bits or none, and only those around a member count
        around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))
    own = F.array_contains("fps", F.col("word"))
    hub = F.when(own, F.col("word")).otherwise(F.col("fps")[0]) if bits == 1 else F.col("fps")[0]
    through = (
        shared.where(F.col("n") > CELL)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.array_distinct(around)).alias("word"))
        .groupBy("word")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .where(own & (F.size("fps") > 1) if bits == 1 else F.size("fps") > 1)
        .select(hub.alias("a"), F.explode("fps").alias("b"))
        .where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    return near.unionByName(through).distinct()


#: Links that a task of a round of ``components`` reads.
ROUND_ROWS = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node that it reaches.

    Rounds end with the first in which every node has one link and none is linked through another; a round's links are read in as many tasks as their number asks for.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = now.select("u", "v", F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
        each = ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.count("*").alias("all"))
        left, n = each.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("all") > F.col("up")))), F.coalesce(F.sum("up"), F.lit(0))).first()
        if not left:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        now = now.coalesce(n // ROUND_ROWS + 1)
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = cut(small)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """``id_col``, text_hash, fingerprint (16 hex digits), component_id (the least id of the component) and keep (on the rows of the one document that stands for it)."""
    seen = cut(fingerprints(docs, text, (id_col,), shingle))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("text")))
    distinct = cut(seen.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    root = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    linked = root.join(distinct, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    stands = distinct.join(linked.join(least, "root").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("c"))
    # rows of a fingerprint with many copies meet it in SALTS parts; there are fewer than a thousand such fingerprints
    crowded = F.broadcast(distinct.where(F.col("n") > max(CROWD, seen.count() // 1000)).select("fp", F.lit(True).alias("crowded")))
    dealt = seen.join(crowded, "fp", "left").withColumn("salt", F.when(F.col("crowded"), F.pmod(F.xxhash64("text_hash", F.col(id_col).cast("string")), F.lit(SALTS)).cast("int")).otherwise(0)).drop("crowded")
    met = stands.join(crowded, "fp", "left").select("fp", "c", F.explode(F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return dealt.join(met, ["fp", "salt"], "left").select(
        id_col,
        "text_hash",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("c.id").alias("component_id"),
        (F.col(id_col).eqNullSafe(F.col("c.id")) & (F.col("text_hash") == F.col("c.text"))).alias("keep"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """The rows of ``docs``, one for each component: that of its least id; of repeated rows one stays."""
    # one pair of keys for the join and for the repeated rows, so the texts are shuffled once
    named = F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull())
    kept = near_duplicates(docs, id_col, text, shingle, bits).where("keep").select(F.col("text_hash").alias("text hash"), named.alias("id hash")).distinct()
    hashed = docs.withColumn("text hash", F.xxhash64(text)).withColumn("id hash", named)
    return hashed.join(kept, ["text hash", "id hash"], "left_semi").dropDuplicates(["text hash", "id hash"]).select(*docs.columns)

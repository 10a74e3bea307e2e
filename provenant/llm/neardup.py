"""Near-duplicates by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Two ways propose which texts to compare.  SimHash: every distinct text has a fingerprint of its shingles, and the grids of
``simhash.links`` join those within ``BITS`` bits.  Similarity 0.8 is about ten of 64 bits, beyond any grid, so every text
also has ``BANDS`` keys, each of ``ROWS`` least hashes of its shingles; two texts of
similarity 0.8 share no key with chance (1 - 0.8 ** ROWS) ** BANDS, 7 in 100,000, and less the more alike
they are.  Texts that are proposed with one another, directly or through others, are a family.  All texts of a
small family are compared; in one of more than ``MEMBERS`` those that share a key are, if that makes fewer meetings (a
key's texts are then a group of their own, and keys with the same texts are one).

Texts of a group are dealt to blocks of about ``MEMBERS``.  First each block is compared within itself and with
``PIVOTS`` texts that all blocks of the group have, and the verified links are closed.  Then pairs of blocks
meet, but texts of the group's largest tree do not meet one another again, so a crowd of true copies costs work in proportion to
its size.  Where blocks meet, the shingles that any two texts share are counted by one product of matrices, and only a forest of
the links found there is returned (each verified on the shingles themselves), so neither pairs nor links grow with the square of a group.

Words are lower-cased (ASCII) and parted by white space, as in ``simhash``.

Defined cases: a null text counts as empty; texts without words are alike; fewer words than a shingle make
one shingle of all words; of each component the row of the least id stays, null ids come last; of repeated
rows one stays; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, tidy
from .simhash import components
from .winnow import Words, _mix, _pieces

SHINGLE, SIMILARITY = 5, 0.8
BITS, ROWS, BANDS = 2, 5, 24
#: Texts, and bytes of text, that are hashed at once.
AT_ONCE, CHUNK = 256, 400_000
#: Texts, and shingles, of a block, and texts that all blocks of a group have; up to ``FEW`` texts are compared one by one; shingles whose counts are multiplied at once.
MEMBERS, SHINGLES, PIVOTS, FEW, COLUMNS = 256, 1_000_000, 16, 6, 8192

#: ASCII letters in lower case, ASCII white space as blanks.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))
_r = np.random.default_rng(42)
_XOR, _TIMES = _r.integers(0, 1 << 64, ROWS * BANDS, np.uint64), _r.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, n: int = SHINGLE) -> set[bytes]:
    """The word shingles of a text."""
    words = text.lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def alike(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is ``SIMILARITY`` or more, in whole numbers."""
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners and hashes of the distinct shingles of all texts, by text, and where each text's begin."""
    words = Words(texts, _LOWER)
    grams, valid = words.grams(SHINGLE)
    at = np.flatnonzero(valid)
    owner, hashes = [words.doc[at]], [grams[at]]
    for n in range(SHINGLE):
        few = np.flatnonzero(words.count == n)
        owner.append(few)
        hashes.append(words.grams(n)[0][words.first[few]] if n else np.zeros(len(few), np.uint64))
    doc, h = np.concatenate(owner), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
    doc, h = doc[new], h[new]
    return doc, h, np.searchsorted(doc, np.arange(len(texts)))


def described(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of distinct shingles of each text, its keys, and the fingerprint of its distinct shingles."""
    _, h, start = hashed(texts)
    out = np.zeros((len(texts), BANDS), np.uint64)
    for k in range(ROWS * BANDS):
        band = k // ROWS
        out[:, band] = _mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((h ^ _XOR[k]) * _TIMES[k], start) + np.uint64(band))
    return np.diff(np.append(start, len(h))), out, simhash.fold(h, start)


def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles of each text, and its keys."""
    return described(texts)[:2]


def keyed(texts: DataFrame) -> DataFrame:
    """node, n (distinct shingles), keys and fp (fingerprint) of each row of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                for at, some in _pieces([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], CHUNK):
                    n, found, fps = described(some)
                    flat = pa.array(found.view(np.int64).ravel())
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(some)), pa.array(n, pa.int64()), rows, pa.array(fps.view(np.int64))], ["node", "n", "keys", "fp"])
        tidy()

    return texts.mapInArrow(run, "node long, n long, keys array<long>, fp long")


def forest(texts: list[bytes], side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all texts that are alike, directly or through others; with ``side``, only links between texts of different sides count."""
    d = len(texts)
    if d <= FEW:
        sets = [shingles(t) for t in texts]
        near = np.zeros((d, d), bool)
        for i in range(d):
            for j in range(i):
                if side is None or side[i] != side[j]:
                    near[i, j] = near[j, i] = alike(sets[i], sets[j])
    else:
        doc, h, start = hashed(texts)
        n = np.diff(np.append(start, len(h)))
        _, column, many = np.unique(h, return_inverse=True, return_counts=True)
        shared = many > 1
        doc, column = doc[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        both = np.zeros((d, d), np.int64)
        for first in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            has = np.zeros((d, COLUMNS), np.float32)
            has[doc[a:b], column[a:b] - first] = 1
            both += (has @ has.T).astype(np.int64)
        near = 5 * both >= 4 * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(near, False)
        if side is not None:
            near &= np.array(side)[:, None] != np.array(side)[None, :]
    links, left = [], np.ones(d, bool)
    for i in range(d):
        if left[i]:
            left[i], todo = False, [i]
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(near[k] & left).tolist():
                    if d <= FEW or alike(shingles(texts[k]), shingles(texts[j])):
                        left[j] = False
                        todo.append(j)
                        links.append((k, j))
    return links


def compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) among rows (root, one, other, mine, node, text) of the same root and blocks ``one`` and ``other``: each text with the least of those that it is linked with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, texts, side = None, [], [], []

        def done() -> pa.RecordBatch:
            found = forest(texts, side if now and now[1] != now[2] else None) if len(texts) > 1 else []
            tree = {}  # of each text that is linked, the first of its tree
            for k, j in found:
                tree[j] = tree.setdefault(k, k)
            least = {}
            for i, k in tree.items():
                least[k] = min(least.get(k, nodes[i]), nodes[i])
            star = [(least[k], nodes[i]) for i, k in tree.items() if nodes[i] != least[k]]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in star], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for root, one, other, mine, node, text in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5).cast(pa.binary()).to_pylist(), strict=True):
                if (root, one, other) != now:
                    if len(texts) > 1:
                        yield done()
                    now, nodes, texts, side = (root, one, other), [], [], []
                nodes.append(node)
                texts.append(text)
                side.append(mine)
        yield done()
        tidy()

    group = ["root", "one", "other"]
    return rows.select(*group, "mine", "node", "text").repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def _blocks(texts: Column, n: Column) -> Column:
    """Into how many blocks so many texts, with so many shingles, are dealt."""
    return F.greatest(F.ceil(texts / MEMBERS), F.ceil(n / SHINGLES), F.lit(1)).cast("int")


def groups(told: DataFrame) -> DataFrame:
    """Which texts must meet: rows (group, node, n, blocks) from (node, n, keys, fp), each group dealt to so many blocks.

    Families of one block are a group each.  Larger ones are one group, or one group for each key with a different set of texts, whichever makes fewer meetings.
    """
    points = told.select("fp").distinct()
    near = components(simhash.links(points, BITS)).select(F.col("node").alias("fp"), "root")
    keys = F.concat("keys", F.array(F.xxhash64(F.coalesce("root", "fp"))))  # texts of near fingerprints share one more key
    placed = cut(told.join(near, "fp", "left").select("node", "n", F.explode(keys).alias("key")))
    crowd = placed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    crowded = cut(placed.join(crowd, "key"))
    found = components(crowded.where("a <> node").select("a", F.col("node").alias("b")))
    family = cut(found.join(told.select("node", "n"), "node"))
    sized = family.groupBy("root").agg(F.count("*").alias("texts"), _blocks(F.count("*"), F.sum("n")).alias("blocks"))
    wide = sized.where("blocks > 1")
    inside = crowded.join(family.select("node", "root").join(wide, "root"), "node")
    same = [F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")]
    sets = inside.groupBy("root", "key").agg(F.count("*").alias("texts"), _blocks(F.count("*"), F.sum("n")).alias("blocks"), *same)
    once = cut(sets.groupBy("root", "texts", "x", "y").agg(F.min("key").alias("key"), F.max("blocks").alias("blocks")))
    work = once.groupBy("root").agg(F.sum(F.col("texts") * F.col("blocks")).alias("work"))
    split = work.join(wide, "root").where("work < texts * blocks").select("root")
    whole = family.join(sized.join(split, "root", "left_anti"), "root").select(F.col("root").alias("group"), "node", "n", "blocks")
    parts = crowded.join(once.join(split, "root").select("key", "blocks"), "key").select(F.col("key").alias("group"), "node", "n", "blocks")
    return cut(whole.unionByName(parts))


def within(members: DataFrame) -> DataFrame:
    """The first meetings (group, one, other, mine, node): every text in its own block, and the ``PIVOTS`` of a group in all its blocks."""
    own = members.select("group", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("one"), "node")
    drawn = members.where("blocks > 1").groupBy("group", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(PIVOTS))).agg(F.min("node").alias("node"), F.max("blocks").alias("blocks"))
    pivots = drawn.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("one"), "node")
    return own.unionByName(pivots).distinct().select("group", "one", F.col("one").alias("other"), F.col("one").alias("mine"), "node")


def across(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The meetings that are left in groups of several blocks: all pairs of blocks, but for those that hold only texts of the group's largest tree, which are joined already."""
    treed = members.where("blocks > 1").drop("blocks").join(joined, "node", "left").withColumn("tree", F.coalesce("root", "node")).drop("root")
    trees = treed.groupBy("group", "tree").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    largest = F.max(F.struct("texts", "tree", "n")).alias("main")
    summed = trees.groupBy("group").agg(largest, F.sum("texts").alias("texts"), F.sum("n").alias("n")).where("texts > main.texts")
    dealt = summed.select("group", F.col("main.tree").alias("main"), _blocks(F.col("main.texts"), F.col("main.n")).alias("of_main"), _blocks(F.col("texts") - F.col("main.texts"), F.col("n") - F.col("main.n")).alias("of_rest"))
    hashed = F.xxhash64("node", F.lit(8))
    rest = treed.join(dealt, "group").withColumn("rest", F.col("tree") != F.col("main"))
    mine = F.when(F.col("rest"), F.col("of_main") + F.pmod(hashed, F.col("of_rest"))).otherwise(F.pmod(hashed, F.col("of_main"))).cast("int")
    meets = F.sequence(F.when(F.col("rest"), F.lit(0)).otherwise(F.col("of_main")), F.col("of_main") + F.col("of_rest") - 1)
    met = rest.select("group", "node", mine.alias("mine"), F.explode(meets).alias("x"))
    return met.select("group", F.least("mine", "x").alias("one"), F.greatest("mine", "x").alias("other"), "mine", "node")


def links(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root) of the texts (by their xxhash64) that are alike with others, directly or through others."""
    given = docs.select(F.xxhash64(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = cut(keyed(given).dropDuplicates(["node"]))
    members = groups(told)
    known = cut(given.dropDuplicates(["node"]).join(members.select("node").distinct(), "node"))

    def verified(meetings: DataFrame) -> DataFrame:
        return compared(known.join(meetings, "node").withColumnRenamed("group", "root"))

    joined = cut(components(verified(within(members))))
    found = cut(verified(across(members, joined)))
    if found.isEmpty():
        return joined
    return components(found.unionByName(joined.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each component: that of its least id; of repeated rows one stays."""
    named = F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull())
    none, root = F.col(id_col).isNull(), links(docs, text).withColumnRenamed("node", "text hash")
    rows = docs.select(F.xxhash64(text).alias("text hash"), F.struct(none.alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text"), named.alias("named")).alias("row"))
    least = rows.groupBy("text hash").agg(F.min("row").alias("row")).join(root, "text hash", "left").groupBy(F.coalesce("root", "text hash").alias("root")).agg(F.min("row").alias("row"))
    kept = least.select(F.col("row.text").alias("text hash"), F.col("row.named").alias("id hash"))
    hashed = docs.withColumn("text hash", F.xxhash64(text)).withColumn("id hash", named)
    return hashed.join(kept, ["text hash", "id hash"], "left_semi").dropDuplicates(["text hash", "id hash"]).select(*docs.columns)

"""Benchmark decontamination by winnowing.

Both sides are cut into lower-cased words.  Of every ten consecutive words the least hash of their
5-word grams is kept, so a document and an item that share ten words share a kept hash: winnowing's
guarantee for spans of w + k - 1 words, here with k = 5 and w = 6.  Items of n < 10 words are
winnowed with k = n and w = 1.  The items' kept hashes, and the hashes of their whole windows, go into
two bitmaps of a fixed greatest size; document hashes that are in the first are extended to the windows
of ten words around them, those in the second are joined with the items' windows by their words, so no
hash decides a result.  The bitmaps only spare work: whatever passes is joined, however many items.

Defined cases: a null or word-less text has no words and no hits; an item without words has no
window; ids of items are compared as strings, rows with the same item id are one item and a null
item id is listed by none; repeated document rows give repeated results; null document ids keep
their rows; extra columns are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import bound, most, running

GRAM, KEEP_OF, SPAN = 5, 6, 10
#: Bits of a bitmap: at least 64 for each hash up to the greatest size, 32 MB.
LEAST_BITS, MOST_BITS = 16, 28
#: Beyond so many distinct windows of the benchmark they are no longer broadcast but joined by a shuffle.
BROADCAST_WINDOWS = 100_000
#: Beyond so many documents to drop they are no longer broadcast (two longs each) but met by a shuffle.
BROADCAST_HITS = 500_000
#: Bytes of text that are hashed at once; longer texts go in parts.
CHUNK = 2_000_000
#: Bytes of which the totals behind word hashes are held at once.
BLOCK = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: where they are, whose they are, and their hashes."""

    def __init__(self, texts: list[bytes], table: bytes = _LOWER):
        clean = [t.translate(table) for t in texts]
        self.joined = b" ".join([b"", *clean, b""])
        raw = np.frombuffer(self.joined, np.uint8)
        inside = raw != 32
        turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = turn[::2], turn[1::2]
        edges = np.cumsum([1, *(len(t) + 1 for t in clean)])
        self.doc = np.searchsorted(edges, self.start, "right") - 1
        self.first = np.searchsorted(self.start, edges[:-1])  # of each text, its first word
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.hash = _mix(self._sums(raw) + np.uint64(1))

    def _sums(self, raw: np.ndarray) -> np.ndarray:
        """The polynomial of each word's bytes; the prefix totals of a block of bytes are held at once."""
        begun, ended, inverse = (np.zeros(len(self.start), np.uint64) for _ in range(3))
        power = np.full(min(BLOCK, len(raw)), _BASE, np.uint64)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        back = np.full(len(power), _BACK, np.uint64)
        back[:1] = 1
        back = np.multiply.accumulate(back)
        before, scale, unscale = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
        for at in range(0, len(raw), BLOCK):
            part = raw[at : at + BLOCK]
            total = np.append(before, np.add.accumulate(power[: len(part)] * part) * scale + before)
            a, b = np.searchsorted(self.start, [at, at + len(part)])
            begun[a:b], inverse[a:b] = total[self.start[a:b] - at], back[self.start[a:b] - at] * unscale
            a, b = np.searchsorted(self.end, [at, at + len(part)])
            ended[a:b] = total[self.end[a:b] - at]
            before, scale, unscale = total[-1:], scale * power[-1:] * _BASE, unscale * back[-1:] * _BACK
        return (ended - begun) * inverse

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they are one text's."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = h * _BASE + self.hash[j : j + m]
        return _mix(h), self.doc[:m] == self.doc[n - 1 :]

    def windows(self, starts: np.ndarray, n: int) -> list[str]:
        """The n words from each start on, joined by spaces."""
        out = []
        for i in starts.tolist():
            raw = self.joined[int(self.start[i]) : int(self.end[i + n - 1])]
            text = raw.decode()
            out.append(" ".join(filter(None, text.split(" "))) if b"  " in raw else text)
        return out


def winnow(hashes: np.ndarray, whole: np.ndarray, of: int = KEEP_OF) -> np.ndarray:
    """Positions of the grams that are least in a window of ``of`` grams; ``whole``: whether the window from a gram on is one text's."""
    m = len(hashes) - of + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least = hashes[:m].copy()
    for j in range(1, of):
        np.minimum(least, hashes[j : j + m], out=least)
    kept = np.zeros(len(hashes), bool)
    for j in range(of):
        kept[j : j + m] |= (hashes[j : j + m] == least) & whole[:m]
    return np.flatnonzero(kept)


def _pieces(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def parts(text: bytes, overlap: int = SPAN - 1, most: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """A text in parts of about ``most`` bytes, cut at blanks, and the number of the word that each begins with; a part repeats the last ``overlap`` words of the one before."""
    if len(text) <= most:
        yield 0, text
        return
    clean, at, base, kept = text.translate(_LOWER), 0, 0, []
    while at < len(clean):
        end = clean.find(b" ", at + most)
        end = end if end >= 0 else len(clean)
        words = clean[at:end].split()
        yield base, b" ".join([*kept, *words])
        base += len(kept) + len(words)
        kept = [*kept, *words][-overlap:] if overlap else []
        base -= len(kept)
        at = end


def bench_windows(bench: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item (string), window (its words), n (words), whole and kept: hashes of the window and of the gram that winnowing keeps of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _pieces([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                words, rows = Words(some), []
                for n in sorted({min(int(c), SPAN) for c in words.count if c}):
                    whole, valid = words.grams(n)
                    mine = np.flatnonzero(valid & ((words.count[words.doc[: len(whole)]] == n) | (n == SPAN)))
                    grams = words.grams(GRAM)[0] if n == SPAN else whole
                    kept = np.min([grams[mine + j] for j in range(KEEP_OF)], axis=0) if n == SPAN and len(mine) else whole[mine]
                    rows += zip((words.doc[mine] + at).tolist(), words.windows(mine, n), [n] * len(mine), whole[mine].view(np.int64).tolist(), kept.view(np.int64).tolist(), strict=True)
                items = batch.column(0)
                yield pa.RecordBatch.from_arrays(
                    [items.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()), 1))],
                    ["item", "window", "n", "whole", "kept"],
                )

    return bench.select(F.col(item).cast("string"), text).mapInArrow(run, "item string, window string, n int, whole long, kept long")


def bitmap(hashes: DataFrame, column: str, n: int) -> np.ndarray:
    """A bitmap of hashes by their low bits; what comes to the driver is bounded by the bitmap's size."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))
    bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toLocalIterator():
        out[r["at"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    return out


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def candidates(docs: DataFrame, lengths: list[int], kept: np.ndarray, whole: np.ndarray, id_col: str, text: str) -> DataFrame:
    """id, text_hash, n_words and hits (start, n, window) of every row: the windows around kept hashes that the benchmark's bitmaps have."""
    sc = docs.sparkSession.sparkContext
    kept_all, whole_all = sc.broadcast(kept), sc.broadcast(whole)
    hit = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("window", pa.string())])

    def found(words: Words, n: int) -> np.ndarray:
        every, valid = words.grams(n)
        if n < SPAN:
            near = np.flatnonzero(valid)
            near = near[_in(kept_all.value, every[near])] if len(near) else near
        else:
            grams, _ = words.grams(GRAM)
            at = winnow(grams, valid)
            at = at[_in(kept_all.value, grams[at])] if len(at) else at
            near = np.unique((at[:, None] - np.arange(KEEP_OF)).ravel()) if len(at) else at
            near = near[(near >= 0) & (near < len(every))]
            near = near[valid[near]] if len(near) else near
        return near[_in(whole_all.value, every[near])] if len(near) else near

    def of_parts(some: list[tuple[int, bytes]]) -> Iterator[tuple[int, list[dict]]]:
        """The number of the word behind each part's last, and the part's hits."""
        words = Words([part for _, part in some])
        hits: list[list[dict]] = [[] for _ in some]
        for n in lengths:
            starts = found(words, n)
            for i, w in zip(starts.tolist(), words.windows(starts, n), strict=True):
                d = int(words.doc[i])
                hits[d].append({"start": some[d][0] + i - int(words.first[d]), "n": n, "window": w})
        return zip((base + n for (base, _), n in zip(some, words.count.tolist(), strict=True)), hits, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "text_hash", "n_words", "hits"]
        for batch in batches:
            for at, some in _pieces([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]):
                if len(some[-1]) <= CHUNK:
                    told = list(of_parts([(0, t) for t in some]))
                else:  # a long text ends its piece; its parts go one by one
                    told = list(of_parts([(0, t) for t in some[:-1]])) if some[:-1] else []
                    end, hits = 0, {}
                    for one in parts(some[-1], max(SPAN, *lengths, 1) - 1):
                        for end, more in of_parts([one]):
                            hits |= {(h["n"], h["start"]): h for h in more}
                    told.append((end, list(hits.values())))
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in told], pa.int64()), pa.array([h for _, h in told], pa.list_(hit))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, text_hash long, n_words long, hits array<struct<start: int, n: int, window: string>>"
    return docs.select(id_col, F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, schema)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", bench_text: str = "text") -> DataFrame:
    """Per row: id, text_hash, n_words, n_hit, hit_spans (word ranges, end exclusive) and items (sorted strings) of the benchmark's windows that occur in it."""
    listed = cut(bench_windows(bench, item, bench_text))
    n, lengths = listed.count(), sorted(r["n"] for r in listed.select("n").distinct().toLocalIterator())
    seen = cut(candidates(docs, lengths, bitmap(listed, "kept", n), bitmap(listed, "whole", n), id_col, text))
    bounded = (lambda df: F.broadcast(df)) if n <= BROADCAST_WINDOWS else (lambda df: df)
    nothing = "CAST(array() AS array<struct<start: int, end: int>>) AS hit_spans", "CAST(array() AS array<string>) AS items"
    clean = seen.where("size(hits) = 0").selectExpr(f"`{id_col}`", "text_hash", "n_words", "0L AS n_hit", *nothing)
    some = seen.where("size(hits) > 0")
    key = [F.col(id_col).alias("row id"), F.col("text_hash").alias("row text")]
    each = some.select(*key, F.explode("hits").alias("h")).distinct().select("row id", "row text", "h.*")
    met = each.join(bounded(listed.select("window").distinct()), "window", "left_semi")
    spans = met.groupBy("row id", "row text").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    # a span begins a new range where it lies beyond the ends of all before it
    fresh = f"filter(zip_with(spans, {running('transform(spans, s -> s.end)', most)}, (s, u) -> named_struct('start', s.start, 'until', u)), x -> x.until = 0 OR x.start > x.until)"
    ranges = "transform(fresh, (x, k) -> named_struct('start', x.start, 'end', CASE WHEN k + 1 < size(fresh) THEN fresh[k + 1].until ELSE last END))"
    merged = F.expr(bound("last", "array_max(transform(spans, s -> s.end))", bound("fresh", fresh, ranges)))
    of_row = met.select("row id", "row text", "window").distinct().join(bounded(listed.select("window", "item").distinct()), "window")
    items = of_row.groupBy(F.col("row id").alias("item id"), F.col("row text").alias("item text")).agg(F.sort_array(F.collect_set("item")).alias("listed"))
    result = spans.select("row id", "row text", merged.alias("found")).join(items, F.col("row id").eqNullSafe(F.col("item id")) & (F.col("row text") == F.col("item text")), "left")
    dirty = some.select(id_col, "text_hash", "n_words").join(result, F.col(id_col).eqNullSafe(F.col("row id")) & (F.col("text_hash") == F.col("row text")), "left")
    total = F.expr("aggregate(found, 0L, (n, s) -> n + s.end - s.start)")
    return clean.unionByName(dirty.select(id_col, "text_hash", "n_words", F.coalesce(total, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("found", F.expr("CAST(array() AS array<struct<start: int, end: int>>)")).alias("hit_spans"), F.coalesce("listed", F.expr("CAST(array() AS array<string>)")).alias("items")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    named = F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull())
    hit = cut(contamination(docs, bench, id_col, text).where("n_hit > 0").select(F.col("text_hash").alias("text hash"), named.alias("id hash")).distinct())
    if hit.count() <= BROADCAST_HITS:
        hit = F.broadcast(hit)
    hashed = docs.withColumn("text hash", F.xxhash64(text)).withColumn("id hash", named)
    return hashed.join(hit, ["text hash", "id hash"], "left_anti").select(*docs.columns)

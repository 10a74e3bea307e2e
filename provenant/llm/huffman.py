"""Token ids as files of canonical length-limited Huffman codes.

``write`` encodes the texts once into a scratch table, with each partition's counts of every id; their sums
over all documents give code lengths, limited by package-merge; and codes each document as an independent block: its bits from a byte
boundary on, and a checkpoint, the bit at which it starts, for every ``STRIDE`` ids.  Blocks are dealt to shards by
ranges of the id, sorted within them, numbered by the ids of all documents before them and written
once.  The container is Parquet, whose commit survives lost executors:

``<path>/code``    one row: the longest code, ids and their code lengths
``<path>/blocks``  one row a document: id, shard, start, n_tokens, checkpoints, bits

``read`` rebuilds the code table from the lengths and decodes all strides of a batch side by side,
one table look-up an id.

Shards end at keys (id, hash of the ids, row): a bounded number of rows is drawn, the exact tokens between
neighbours among them are counted, and those nearest to equal shares are taken, so that even rows of one id are dealt
to many shards; any sortable type of id will do.

Defined cases: a null text counts as empty; every document ends with ``end_id`` (so an empty one has
one id); rows with the same document id stand together, null document ids before all
others; an empty table gives files without blocks; extra columns are ignored; strings of special tokens in a text
become their ids, as the library does.  Codes are as long as the number of ids in use asks for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import binary, chunks, encoder
from .common import remove, scratch, tidy

#: The longest code, unless more ids are in use than a quarter of such codes; it is one of 25 bits at most.
LONGEST, STRIDE = 18, 256
#: Coded bytes of a shard, the greatest number of shards, rows drawn for each to find the splitters among, and the greatest number of these unless two a shard are more.
SHARD_BYTES, MOST_SHARDS, DRAWN, MOST_DRAWN = 32_000_000, 20_000, 40, 40_000


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits for symbols with the given counts (0: no code), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, packed = leaves, [np.zeros(len(leaves), bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        packed.append(rank >= len(leaves))
    lengths, need = np.zeros(len(leaves), np.int64), 2 * len(leaves) - 2
    for flags in reversed(packed):
        inner = int(flags[:need].sum())
        lengths[: need - inner] += 1
        need = 2 * inner
    out[order] = lengths
    return out


def longest_for(used: int) -> int:
    """The longest code for so many ids: two bits more than they need at least."""
    return max(LONGEST, min(25, max(0, used - 1).bit_length() + 2))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def pack(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, list[int]]]:
    """Bits and checkpoints of each document; ``ends``: where each ends in ``ids``."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    both = (codes << np.uint64(8) | lengths)[ids]  # one look-up an id
    size = (both & np.uint64(255)).astype(np.int64)
    before = np.cumsum(size)
    bits = before[ends - 1]
    before -= size
    first = before[begins]
    bits -= first
    byte_first = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    at = before + np.repeat(8 * byte_first[:-1] - first, ends - begins)
    shifted = (both >> np.uint64(8)) << (64 - size - (at & 31)).view(np.uint64)
    word, n = at >> 5, int(byte_first[-1]) // 4 + 2
    raw = np.bincount(word, (shifted >> np.uint64(32)).astype(float), n) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(float), n)
    data = raw.astype(">u4").tobytes()
    edges = byte_first.tolist()
    return [(data[edges[i] : edges[i + 1]], (before[b:e:STRIDE] - first[i]).tolist()) for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True))]


class Decoder:
    """Decodes blocks through a table of all bit strings of the longest code's length."""

    def __init__(self, lengths: np.ndarray, longest: int):
        codes = canonical(lengths)
        self.longest = longest
        self.symbol, self.size = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = np.left_shift(1, longest - lengths[order].astype(np.int64))
        if len(order):
            n = int((codes[order[-1]] + np.uint64(1)) << np.uint64(longest - int(lengths[order[-1]])))
            self.symbol[:n], self.size[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)

    def unpack(self, blocks: list[bytes], counts: np.ndarray, checkpoints: list[list[int]]) -> np.ndarray:
        """The ids of all blocks, one after another."""
        raw = np.frombuffer(b"".join(blocks) + bytes(8), np.uint8)
        wide = raw.astype(np.uint32)
        window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        base = 8 * np.cumsum([0, *map(len, blocks)])[:-1]
        strides = np.array([len(c) for c in checkpoints], np.int64)
        at = np.concatenate([np.zeros(0, np.int64), *(np.array(c, np.int64) + b for c, b in zip(checkpoints, base.tolist(), strict=True))])
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        number = np.arange(len(at)) - np.repeat(np.cumsum(strides) - strides, strides)
        to = np.repeat(begin, strides) + STRIDE * number
        left = np.minimum(STRIDE, np.repeat(counts, strides) - STRIDE * number)
        order = np.argsort(-left, kind="stable")
        at, to, left = at[order], to[order], left[order]
        alive = np.searchsorted(-left, -np.arange(1, STRIDE + 1), "right")
        out, down, mask = np.zeros(int(counts.sum()), np.uint32), 32 - self.longest, np.uint32((1 << self.longest) - 1)
        for step in range(STRIDE):
            n = int(alive[step])
            if not n:
                break
            at = at[:n]
            peek = (window[at >> 3] >> (down - (at & 7)).astype(np.uint32)) & mask
            out[to[:n] + step] = self.symbol[peek]
            at = at + self.size[peek]
        return out


def _tokens(docs: DataFrame, path: str, end_id: int, id_col: str, text: str, kind: str) -> DataFrame:
    """Document id, n_tokens (with the end id) and ids as 16-bit integers where the vocabulary allows; after each partition's rows a row without n_tokens that holds how often each id occurs in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = "<u2" if len(enc.lengths) <= 1 << 16 else "<u4"
        names, total = [id_col, "n_tokens", "ids", "counts"], np.zeros(max(end_id + 1, len(enc.lengths)), np.int64)
        for batch in batches:
            at = 0
            for some in chunks([t or "" for t in batch.column(1).to_pylist()]):
                ids, ends = enc.ids_of(some)
                ids = np.insert(ids.astype(width), ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                total += np.bincount(ids, minlength=len(total))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(np.diff(ends, prepend=0), pa.int64()), binary(ids, ends), pa.nulls(len(some), pa.binary())], names)
                at += len(some)
        tidy()
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.schema.field(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, counts binary")


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0, shards: int | None = None) -> None:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of ``id_col``."""
    spark = docs.sparkSession
    kind, held = docs.schema[id_col].dataType.simpleString(), scratch(spark, "tokens")
    _tokens(docs, tokenizer, end_id, id_col, text, kind).withColumn("text key", F.xxhash64("ids")).write.option("compression", "snappy").parquet(held)
    tokens = spark.read.parquet(held).where("n_tokens IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total = np.frombuffer(data, np.int64)
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    # at most one row for each id of the vocabulary comes to the driver
    counted = spark.read.parquet(held).where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in counted), default=0), np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    longest = longest_for(int((counts > 0).sum()))
    lengths = code_lengths(counts, longest)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(longest, used.tolist(), lengths[used].astype(int).tolist())], "longest int, ids array<int>, lengths array<int>").coalesce(1).write.parquet(f"{path}/code")

    coded = int((counts * lengths).sum()) // 8
    shards = shards or max(1, min(MOST_SHARDS, -(-coded // SHARD_BYTES)))
    tokens = tokens.withColumn("key", F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.col("text key").alias("text"), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row")))
    many = shards * max(2, min(DRAWN, MOST_DRAWN // shards)) if shards > 1 else 0
    drawn = [r["key"].asDict() for r in tokens.select("key").orderBy(F.xxhash64("key.row", "key.text")).limit(many).orderBy("key").collect()] if many else []
    among = _bucketed(tokens.select("key", "n_tokens"), drawn, kind).groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each drawn row at most
    each = np.zeros(len(drawn) + 1, np.int64)
    for r in among:
        each[r["bucket"]] = r["n"]
    below = np.cumsum(each)  # below[k]: tokens before the k-th drawn row
    cuts = sorted({int(np.abs(below[:-1] - below[-1] * i / shards).argmin()) for i in range(1, shards)}) if drawn else []
    edges = [drawn[k] for k in cuts]
    before = [0, *(int(below[k]) for k in cuts)]  # of each shard, the tokens before it
    dealt = _bucketed(tokens, edges, kind).withColumnRenamed("bucket", "shard").drop("key")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                each = [_ids(d, n) for n, d in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                done = pack(np.concatenate(each), np.cumsum([len(x) for x in each]), lengths, codes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([c for _, c in done], pa.list_(pa.int64())), pa.array([b for b, _ in done], pa.binary())], [id_col, "shard", "n_tokens", "checkpoints", "bits"])
        tidy()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = 0, None
        for batch in batches:
            starts = []
            for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != now:
                    now, at = s, before[s]
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], [*batch.schema.names, "start"])

    schema = f"`{id_col}` {kind}, shard int, n_tokens long, checkpoints array<long>, bits binary"
    blocks = dealt.select(id_col, "shard", "n_tokens", "ids").mapInArrow(code, schema)
    ordered = blocks.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", F.col(id_col).asc_nulls_first(), "bits")
    ordered.mapInArrow(number, f"{schema}, start long").write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, held)


def _bucketed(rows: DataFrame, edges: list[dict], kind: str) -> DataFrame:
    """``rows`` with bucket: how many of the sorted edges are at most a row's key, by binary search."""
    steps = f"array({', '.join(str(1 << k) for k in reversed(range(max(1, len(edges)).bit_length())))})"
    at = f"aggregate({steps}, 0, (at, step) -> CASE WHEN at + step <= {len(edges)} AND key >= element_at(edges, at + step) THEN at + step ELSE at END)"
    held = F.from_json(F.lit(json.dumps(edges, default=str)), f"array<struct<known: boolean, id: {kind}, text: bigint, row: bigint>>")
    return rows.withColumn("edges", held).withColumn("bucket", F.expr(at)).drop("edges")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Document id, start, n_tokens and ids (binary: little-endian unsigned 32-bit) of every block."""
    head = spark.read.parquet(f"{path}/code").first()
    lengths = np.zeros(1 + max(head["ids"], default=0), np.uint8)
    lengths[head["ids"]] = head["lengths"]
    longest = head["longest"]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths, longest)
        for batch in batches:
            for at in range(0, batch.num_rows, 1500):
                part = batch.slice(at, 1500)
                counts = np.array(part.column(2).to_pylist(), np.int64)
                data = decoder.unpack(part.column(4).to_pylist(), counts, part.column(3).to_pylist()).astype("<u4", copy=False).tobytes()
                ends = (4 * np.cumsum(counts)).tolist()
                ids = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(ids, pa.binary())], [id_col, "start", "n_tokens", "ids"])
        tidy()

    return blocks.select(id_col, "start", "n_tokens", "checkpoints", "bits").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")

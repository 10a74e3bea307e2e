"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file of a byte-level vocabulary becomes a ``tokenizers`` model once per Python worker:
every byte has one printable character (the byte table), a token's string is its bytes through
that table, and the merges are all pairs of tokens whose concatenation is a token, by its rank.

Texts are cut into segments where the pre-tokenisation pattern always starts a new match: before
a single space that has a non-space character on both sides.  Segments repeat, so each worker keeps
the ids of those that it met lately as Arrow and numpy arrays, and only the others reach the library,
joined into one text whose ids are dealt back by byte length.  Segments of letters with punctuation behind them, whose
two matches need no pattern, are joined in the byte table's own characters and parted by blanks.

Defined cases: a null text counts as empty and has no ids; an empty text has no ids and decodes to
empty bytes; texts of any length are encoded whole; repeated rows give repeated results; extra
columns pass through ``encode`` and ``decode`` only when named in ``keep``; an empty table gives
an empty table.  In a rank vocabulary strings of special tokens are ordinary text; those of a file in the
library's own format become their ids, as the library does unless told otherwise.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import tidy

#: Characters of a piece of text that is handled at once.
CHUNK_CHARS = 4_000_000
#: Bytes of text that are encoded and decoded at once.
SLICE_BYTES = 2_000_000
#: Beyond so many segments or bytes a worker forgets those that it has not met twice since it last forgot; longer segments are never kept.
MEMO_SEGMENTS, MEMO_BYTES, MEMO_LONGEST = 400_000, 16_000_000, 200
#: Bytes of segments that the library gets at once.
JOINED = 200_000

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Letters that every version of Unicode calls so, and ASCII punctuation without the apostrophe: a match of the pattern each.
_LETTERS, _PUNCTUATION = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
#: How a pattern must end for texts to be cut into segments; a fixed value.
_PLAIN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EASY = f"^([{_LETTERS}]+)([{_PUNCTUATION}]*)$"
#: White space besides space and line feed; fixed values.
_RARE_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def is_odd(text: str) -> bool:
    """Whether a space of the text may not be a boundary of segments."""
    odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
    return odd or any(c in text for c in (_RARE_SPACE[:8] if text.isascii() else _RARE_SPACE))


def _joined(words: pa.Array, by: str) -> bytes:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(by, words.type))[0].as_buffer().to_pybytes()


class Encoder:
    """Encodes texts by a ``tokenizers`` model; ``exact`` re-encodes segments in which the model's choice among equal ranks could matter.

    ``cuts``: whether texts may be cut into segments; ``easy``: whether segments of letters and punctuation may go around the pattern.
    """

    def __init__(self, model, token_bytes: dict[int, bytes], triggers=None, exact=None, cuts: bool = True, easy: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        model.model._resize_cache(0)  # the memo has what repeats
        self.model, self.triggers, self.exact, self.cuts, self.plain = model, triggers, exact, cuts, None
        if cuts and easy:
            self.plain = Tokenizer(model.model)
            self.plain.pre_tokenizer = WhitespaceSplit()
        self.chars = np.array([ord(c) for c in byte_table()], "<u2")
        self.chars[[10, 32]] = 10, 32  # between segments, and between the matches of one
        self.token_bytes = token_bytes
        self.lengths = np.zeros(max(token_bytes, default=0) + 1, np.int64)
        for i, b in token_bytes.items():
            self.lengths[i] = len(b)
        self.table = [token_bytes.get(i, b"") for i in range(len(self.lengths))]
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.words, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.begin, self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _alone(self, text: str) -> np.ndarray:
        if self.exact is not None and self.triggers is not None and any(True for _ in self.triggers.iter(text.encode().decode("latin-1"))):
            return np.array(self.exact(text), np.uint32)
        return self._raw(text)

    def _batch(self, words: pa.Array, sizes: np.ndarray, easy: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments without white space at their ends, each after a space, and their numbers; ``sizes``: their bytes."""
        raw = b" " + _joined(words, " ") if self.triggers is not None or not easy else b""
        if easy:
            parted = pc.replace_substring_regex(words, f"^([{_LETTERS}]+)([{_PUNCTUATION}]+)$", r"\1 \2")
            text = self.chars[np.frombuffer(b"\n" + _joined(parted, "\n"), np.uint8)].tobytes().decode("utf-16-le").replace("\n", " \u0120")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        else:
            ids = self._raw(raw.decode())
        done, ends = np.cumsum(self.lengths[ids]), np.cumsum(sizes + 1)
        cuts = np.searchsorted(done, ends) + 1
        if not np.array_equal(done[cuts - 1], ends):
            raise ValueError("a token spans two segments")
        n = np.diff(cuts, prepend=0)
        if self.triggers is not None:
            hits = np.fromiter((e for e, _ in self.triggers.iter(raw.decode("latin-1"))), np.int64)
            if len(flagged := np.unique(np.searchsorted(ends, hits, "right"))):
                out, at = [], 0
                for k in flagged.tolist():
                    again = np.array(self.exact(" " + words[k].as_py()), np.uint32)
                    out += [ids[at : cuts[k] - n[k]], again]
                    at, n[k] = cuts[k], len(again)
                ids = np.concatenate([*out, ids[at:]])
        return ids, n

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct segments, each after a space, and where each segment's begin and how many they are."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        kind = np.zeros(len(words), np.int8)  # 0: joined, 1: joined around the pattern, 2: alone
        if self.plain is not None:
            kind[pc.match_substring_regex(words, _EASY).to_numpy(zero_copy_only=False)] = 1
        hard = np.flatnonzero(kind == 0)
        kind[hard[[not w or w[-1].isspace() for w in words.take(pa.array(hard)).to_pylist()]]] = 2
        pool, number, filled = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = 0
        for which in (0, 1):
            mine = np.flatnonzero(kind == which)
            some, before = words.take(pa.array(mine)), np.cumsum(size[mine] + 1)
            first = 0
            while first < len(mine):
                end = max(first + 1, int(np.searchsorted(before, (before[first - 1] if first else 0) + JOINED, "right")))
                ids, n = self._batch(some.slice(first, end - first), size[mine[first:end]], which == 1)
                pool.append(ids)
                number[mine[first:end]], filled[mine[first:end]] = n, at + np.cumsum(n) - n
                at, first = at + len(ids), end
        for i in np.flatnonzero(kind == 2).tolist():
            ids = self._alone(" " + words[i].as_py()) if size[i] else np.zeros(0, np.uint32)
            pool.append(ids)
            number[i], filled[i] = len(ids), at
            at += len(ids)
        return np.concatenate([np.zeros(0, np.uint32), *pool]), filled, number

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it the ids of each of distinct segments begin and how many they are."""
        found = pc.index_in(words, self.words)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        old, gaps = at >= 0, np.flatnonzero(at < 0)
        self.uses[at[old]] += 1
        new = words.take(pa.array(gaps))
        ids, begin, size = self._fresh(new)
        pool = np.concatenate([self.pool, ids])
        starts, numbers = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[old], numbers[old] = self.begin[at[old]], self.size[at[old]]
        starts[gaps], numbers[gaps] = begin + len(self.pool), size
        every = pa.concat_arrays([self.words, new])
        self._keep(every, pool, np.concatenate([self.begin, begin + len(self.pool)]), np.concatenate([self.size, size.astype(np.int32)]), np.concatenate([self.uses, np.zeros(len(new), np.int32)]))
        return pool, starts, numbers

    def _keep(self, words: pa.Array, pool: np.ndarray, begin: np.ndarray, size: np.ndarray, uses: np.ndarray) -> None:
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
        stay = lengths <= MEMO_LONGEST
        full = len(words) > MEMO_SEGMENTS or lengths[stay].sum() > MEMO_BYTES
        if full:
            stay &= uses > (0 if (uses[stay] > 0).sum() <= MEMO_SEGMENTS // 2 else np.median(uses[stay]))
        if not stay.all():
            begin, size, uses = begin[stay], size[stay], uses[stay]
            words, last = words.filter(pa.array(stay)), np.cumsum(size, dtype=np.int64)
            pool = pool[np.repeat(begin - last + size, size) + np.arange(last[-1] if len(last) else 0)]
            begin = last - size
        self.words, self.pool, self.begin, self.size, self.uses = words, pool, begin, size, np.zeros(len(words), np.int32) if full else uses

    def _heads(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that nothing stands before."""
        if self.triggers is not None:
            return [self._alone(t) if t else np.zeros(0, np.uint32) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.cuts:
            each = self._heads(texts)
            return np.concatenate(each), np.cumsum([len(x) for x in each])
        odd = [i for i, t in enumerate(texts) if is_odd(t)]
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edges, flat = lists.offsets.to_numpy().copy(), lists.values
        if odd:  # their segments instead of what the split made
            pieces, at, sizes = [], 0, np.diff(edges)
            for i in odd:
                parts = _SAFE.split(texts[i])
                pieces += [flat.slice(edges[at], edges[i] - edges[at]), pa.array(parts, pa.large_string())]
                at, sizes[i] = i + 1, len(parts)
            flat = pa.concat_arrays([*pieces, flat.slice(edges[at])])
            edges = np.concatenate([[0], np.cumsum(sizes)])
        coded = flat.dictionary_encode()
        heads = edges[:-1]
        index, words = coded.indices.to_numpy().copy(), len(coded.dictionary)
        index[heads] = words + np.arange(len(heads), dtype=np.int32)  # a text's first segment has no space before it
        used = np.bincount(index, minlength=words)[:words] > 0
        pool, begin, size = self._known(coded.dictionary.filter(pa.array(used)))
        first = self._heads(flat.take(pa.array(heads)).to_pylist())
        n = np.array([len(x) for x in first], np.int64)
        begin = np.concatenate([begin, len(pool) + np.cumsum(n) - n])
        size, pool = np.concatenate([size, n]).astype(np.int32), np.concatenate([pool, *first])
        place = np.concatenate([np.cumsum(used, dtype=np.int32) - 1, int(used.sum()) + np.arange(len(heads), dtype=np.int32)])
        index = place[index]
        each = size[index]
        done = np.cumsum(each, dtype=np.int64)
        kind = np.int32 if done[-1] < 1 << 30 and len(pool) < 1 << 30 else np.int64
        where = np.repeat((begin[index] - done + each).astype(kind), each)
        where += np.arange(done[-1], dtype=kind)
        return pool[where], np.concatenate([[0], done])[edges[1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.ids_of(texts)
        data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids as ``encode`` gives them."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids as one binary value a text, without a copy; ``ends``: where each text's end."""
    offsets = np.concatenate([[0], ends * ids.itemsize])
    if offsets[-1] >= 1 << 31:
        data = ids.tobytes()
        return pa.array([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in pieces of about CHUNK_CHARS characters."""
    out, chars = [], 0
    for t in texts:
        out.append(t)
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield out
            out, chars = [], 0
    if out:
        yield out


def sliced(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column (null: empty) in runs of about ``most`` bytes, and where each run begins; only one run is held as strings."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


# -- a vocabulary of ranks ------------------------------------------------------------------------


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs of tokens that make a token, by its rank and then from the shortest left part."""
    return [(t[:i], t[i:]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


def contested(ranks: dict[bytes, int]) -> list[bytes]:
    """Byte strings p+q+s in which p+q and q+s are the same token by different pairs: only where one occurs can equal ranks be merged in two ways."""
    found = set()
    for t in ranks:
        for n in range(1, len(t)):
            p, q, s = t[: len(t) - n], t[len(t) - n :], t[n:]
            if p != q and t.startswith(q) and p in ranks and q in ranks and s in ranks:
                found.add(p + q + s)
    return sorted(found)


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The lowest rank among neighbouring pairs is merged first, the leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair and (low := min(pair)) < none:
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def from_ranks(path: str, pattern: str) -> Encoder:
    """An encoder whose ids are those of a rank vocabulary, each match of ``pattern`` encoded separately."""
    import ahocorasick
    import regex
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    ranks, chars = read_ranks(path), byte_table()
    named = {t: "".join(chars[b] for b in t) for t in ranks}
    model = Tokenizer(BPE(vocab={named[t]: i for t, i in ranks.items()}, merges=[(named[a], named[b]) for a, b in merges_of(ranks)], ignore_merges=True))
    model.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    triggers = ahocorasick.Automaton()
    for t in contested(ranks):
        triggers.add_word(t.decode("latin-1"), 1)
    triggers.make_automaton()
    pieces = regex.compile(pattern)
    cuts = pattern.endswith(_PLAIN)
    return Encoder(model, {i: t for t, i in ranks.items()}, triggers if len(triggers) else None, lambda text: [i for p in pieces.findall(text) for i in merge_by_rank(p.encode(), ranks)], cuts=cuts, easy=cuts)


def from_file(path: str) -> Encoder:
    """An encoder for a byte-level vocabulary in the library's own file format, special tokens included."""
    from tokenizers import Tokenizer

    model, back = Tokenizer.from_file(path), {c: b for b, c in enumerate(byte_table())}
    added = model.get_added_tokens_decoder()
    given = json.loads(model.to_str())
    byte_level = given["normalizer"] is None and given["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    cuts = byte_level and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added.values())
    easy = not any(re.fullmatch(f" ?[{_LETTERS}]*[{_PUNCTUATION}]*", t.content) for t in added.values())
    return Encoder(model, {i: added[i].content.encode() if i in added else bytes(back[c] for c in t) for t, i in model.get_vocab().items()}, cuts=cuts, easy=easy)


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The worker's encoder of a vocabulary file: ranks with their pattern, or the library's own format."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = from_ranks(path, pattern) if pattern else from_file(path)
    return _ENCODERS[path, pattern]


# -- operators ------------------------------------------------------------------------------------


def offsets_of(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token; a token that holds part of a character's bytes covers the whole character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    number = np.cumsum((raw & 0xC0) != 0x80) - 1  # of the character that each byte belongs to
    ends = np.cumsum(lengths[ids])
    return number[ends - lengths[ids]], number[ends - 1] + 1


def encode(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens and ids (binary: little-endian unsigned 32-bit); with ``offsets``, each token's first and end character too."""
    extra = ", token_start array<int>, token_end array<int>" if offsets else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + (", " if keep else "") + "n_tokens long, ids binary" + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            at = 0
            for some in chunks([t or "" for t in batch.column(len(keep)).to_pylist()]):
                ids, ends = enc.ids_of(some)
                cols = [batch.column(i).slice(at, len(some)) for i in range(len(keep))]
                at += len(some)
                cols += [pa.array(np.diff(ends, prepend=0), pa.int64()), binary(ids.astype("<u4"), ends)]
                names = [*keep, "n_tokens", "ids"]
                if offsets:
                    both = [offsets_of(t, ids[a:b], enc.lengths) if a < b else ((), ()) for t, a, b in zip(some, [0, *ends], ends, strict=False)]
                    cols += [pa.array([list(b[k]) for b in both], pa.list_(pa.int32())) for k in (0, 1)]
                    names += ["token_start", "token_end"]
                yield pa.RecordBatch.from_arrays(cols, names)
        tidy()

    return docs.select(*keep, text).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids and decoded: ``encode`` and ``decode`` of the ids in one pass through a worker."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + (", " if keep else "") + "n_tokens long, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at, some in sliced(batch.column(len(keep))):
                ids, ends = enc.ids_of(some)
                cols = [batch.column(i).slice(at, len(some)) for i in range(len(keep))]
                data = binary(ids.astype("<u4"), ends)
                cols += [pa.array(np.diff(ends, prepend=0), pa.int64()), data, pa.array((enc.decode(x.as_py()) for x in data), pa.binary(), size=len(data))]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids", "decoded"])
        tidy()

    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """``keep`` columns and decoded (binary): the bytes of the ids joined, so characters split over tokens come back whole."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema) + (", " if keep else "") + "decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [enc.decode(x or b"") for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(out, pa.binary())], [*keep, "decoded"])

    return encoded.selectExpr(*(f"`{k}`" for k in keep), "ids as `ids to decode`").mapInArrow(run, schema)

"""BPE encoding and decoding with word ends, by contiguous rank arrays.

The vocabulary is a file of the tokenizers library.  A text falls into segments at white space, which no match of the
pre-tokenisation pattern spans; segments repeat, so a worker keeps the ids of those that it met lately and works out only
the others.  Their normal form and matches are the library's own (ASCII segments go by the same pattern in Python).

Each distinct match is a word of bytes, the last with the word-end suffix.  Words of one length are merged together: a row
of a matrix holds a word's parts between its boundaries, a second one the ranks of adjacent parts, both contiguous.
Every round scans each row for its least rank (the leftmost of equal ones), deletes that boundary by moving what follows it
up, and refreshes the two neighbouring ranks; rows without a mergeable pair leave.  All rows of a matrix have lost as
many boundaries, so it stays rectangular.  The scans are quadratic in a word, so words of more than ``SHORT`` bytes go by a heap of ranks.

Decoding is the library's for a file without a decoder: the tokens' strings joined by single spaces.

Defined cases: a null text counts as empty and has no ids, an empty text decodes to an empty one; strings of special tokens
become their ids, as the library does by default; texts of any length are encoded whole, in parts cut at white space; a match
of any length is one word; repeated rows give repeated results; extra columns pass only when named in ``keep``; an
empty table gives an empty table.  A file whose parts this module does not know is an error.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import byte_table, chunks
from .common import tidy

#: Bytes of a word up to which the rank array is scanned; characters of text that are segmented at once.
SHORT, PART = 64, 2_000_000
#: Segments that a worker keeps, the longest of them, and cells of a matrix of words.
MEMO, LONGEST, CELLS = 300_000, 100, 4_000_000

#: White space of Unicode, at which no match goes on; fixed values.
_SPACE = r"[\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The parts of a file that this module works by; fixed values.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: The pattern over lower-cased ASCII, and a line feed between segments.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\n", re.ASCII)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each of some runs, one run after another."""
    done = np.cumsum(size)
    return np.repeat(begin - done + size, size) + np.arange(done[-1] if len(done) else 0)


class Merges:
    """The merges of a vocabulary, and words merged by them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        chars = byte_table()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.width = max(vocab.values()) + 1
        self.none = len(merges)  # the rank of a pair that is no merge
        self.ranks = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.made = np.array([vocab[a + b] for a, b in merges] + [-1], np.int64)
        keys = np.array([a * self.width + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.of_key = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array([*self.ranks.values()], np.int32)[order], self.none).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of parts."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.of_key[at], np.int32(self.none))

    def scan(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and parts of the words (a row of bytes each) by rounds: of those that have no mergeable pair left."""
        parts, row = self.inner[words], np.arange(len(words))
        parts[:, -1] = self.last[words[:, -1]]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(row):
            width = parts.shape[1]
            if width == 1:
                yield row, parts
                return
            at = ranks.argmin(1)
            low = ranks[np.arange(len(row)), at]
            over = low == self.none
            if over.any():
                yield row[over], parts[over]
                row, parts, ranks, at, low = (x[~over] for x in (row, parts, ranks, at, low))
            n, before = np.arange(len(row)), at[:, None]
            parts[n, at] = self.made[low]
            columns = np.arange(width - 1)
            parts = np.take_along_axis(parts, columns + (columns > before), 1)
            columns = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, columns + (columns >= before), 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self.rank(parts[left, at[left] - 1], parts[left, at[left]])
            ranks[right, at[right]] = self.rank(parts[right, at[right]], parts[right, at[right] + 1])

    def heap(self, word: bytes) -> np.ndarray:
        """The parts of a long word: the least rank, the leftmost of equal ones, from a heap."""
        raw = np.frombuffer(word, np.uint8)
        parts = [*self.inner[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        todo = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(todo)
        while todo:
            r, i = heapq.heappop(todo)
            j = after[i]
            if parts[i] < 0 or j < 0 or self.ranks.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(todo, (r, a))
        return np.array([p for p in parts if p >= 0], np.int64)

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where the ids of each word (binary, not empty) begin in it and how many they are."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        length = np.diff(offsets)
        begin, size, pool, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)], 0
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            if n > SHORT:
                found = (((mine[k : k + 1]), self.heap(words[int(i)].as_py())[None, :]) for k, i in enumerate(mine.tolist()))
            else:
                step = max(1, CELLS // n)
                found = ((mine[a : a + step][row], parts) for a in range(0, len(mine), step) for row, parts in self.scan(raw[offsets[mine[a : a + step]][:, None] + np.arange(n)]))
            for row, parts in found:
                pool.append(parts.astype(np.uint32).ravel())
                size[row], begin[row] = parts.shape[1], at + parts.shape[1] * np.arange(len(row))
                at += parts.size
        return np.concatenate(pool), begin, size


class WordEncoder:
    """Encodes and decodes texts by a vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        given, added = json.loads(model.to_str()), model.get_added_tokens_decoder()
        of = given["model"]
        known = of["type"] == "BPE" and of["end_of_word_suffix"] and not any(of.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        known = known and (given["normalizer"] or {}).get("normalizers") == _NORMALS and (given["pre_tokenizer"] or {}).get("pretokenizers") == _SPLITS and given["post_processor"] is None and given["decoder"] is None
        if not known or any(t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"\s", t.content) for t in added.values()):
            raise ValueError(f"{path} is not a BPE vocabulary with word ends of the known kind")
        self.normal, self.splits = model.normalizer, model.pre_tokenizer
        self.merges = Merges(of["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in of["merges"]], of["end_of_word_suffix"])
        self.special = {t.content: i for i, t in added.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        names = {i: t for t, i in model.get_vocab(with_added_tokens=True).items()}
        self.tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self.forget()

    def forget(self) -> None:
        """Empty the memo of segments."""
        self.words, self.pool, self.begin, self.size = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _matches(self, segments: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The matches (binary) of all segments and whose each is; ASCII by the pattern, others by the library."""
        ascii_ = pc.string_is_ascii(segments).to_numpy(zero_copy_only=False)
        words, owner = [], []
        plain, other = np.flatnonzero(ascii_), np.flatnonzero(~ascii_)
        if len(plain):
            found = pa.array(_ASCII.findall("\n".join(segments.take(pa.array(plain)).to_pylist()).lower()), pa.binary())
            edge = pc.equal(found, b"\n").to_numpy(zero_copy_only=False)
            words.append(found.filter(pa.array(~edge)))
            owner.append(plain[np.cumsum(edge)[~edge]])
        if len(other):
            normal = self.normal.normalize_str("\n".join(segments.take(pa.array(other)).to_pylist()))
            gaps = np.array([m.start() for m in re.finditer(" ", normal)], np.int64)
            if len(gaps) != len(other) - 1:
                raise ValueError("white space within a segment")
            found = [place for _, place in self.splits.pre_tokenize_str(normal)]
            words.append(pa.array([normal[a:b].encode() for a, b in found], pa.binary()))
            owner.append(other[np.searchsorted(gaps, np.array([a for a, _ in found], np.int64))])
        whose = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(whose, kind="stable")
        return pa.concat_arrays(words).take(pa.array(order)) if words else pa.array([], pa.binary()), whose[order]

    def _fresh(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where the ids of each distinct segment begin in it and how many they are."""
        number = len(segments)
        special = np.zeros(number, bool)
        if self.specials is not None:
            for s in self.special:
                special |= pc.match_substring(segments, s).to_numpy(zero_copy_only=False)
        usual = np.flatnonzero(~special)
        words, owner = self._matches(segments.take(pa.array(usual)))
        coded = words.dictionary_encode()
        pool, begin, size = self.merges.merged(coded.dictionary)
        index = coded.indices.to_numpy()
        ids = pool[spread(begin[index], size[index])]
        sizes = np.zeros(number, np.int64)
        sizes[usual] = np.bincount(owner, size[index], len(usual)).astype(np.int64)
        starts, pieces = np.cumsum(sizes) - sizes, [ids]
        for i in np.flatnonzero(special).tolist():  # the strings between special tokens are texts of their own
            parts = [p for p in self.specials.split(segments[i].as_py()) if p]
            each = [np.array([self.special[p]], np.uint32) if p in self.special else self._alone(p) for p in parts]
            starts[i], sizes[i] = sum(map(len, pieces)), sum(map(len, each))
            pieces += each
        return np.concatenate(pieces), starts, sizes

    def _alone(self, segment: str) -> np.ndarray:
        words, _ = self._matches(pa.array([segment], pa.large_string()))
        pool, begin, size = self.merges.merged(words)
        return pool[spread(begin, size)]

    def _known(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_fresh``, for distinct segments of which the memo has some."""
        at = pc.index_in(segments, self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = segments.take(pa.array(new))
        ids, first, many = self._fresh(fresh)
        pool = np.concatenate([self.pool, ids])
        begin, size = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        begin[at >= 0], size[at >= 0] = self.begin[at[at >= 0]], self.size[at[at >= 0]]
        begin[new], size[new] = first + len(self.pool), many
        short = pc.less_equal(pc.binary_length(fresh), LONGEST).to_numpy(zero_copy_only=False)
        if len(self.words) + short.sum() > MEMO:
            self.forget()
        where = spread(first[short], many[short])
        done = len(self.pool) + np.cumsum(many[short])
        self.words, self.pool = pa.concat_arrays([self.words, fresh.filter(pa.array(short))]), np.concatenate([self.pool, ids[where]])
        self.begin, self.size = np.concatenate([self.begin, done - many[short]]), np.concatenate([self.size, many[short]])
        return pool, begin, size

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after another, and how many each has."""
        spaced = pc.replace_substring_regex(pa.array(texts, pa.large_string()), _SPACE, " ")
        lists = pc.split_pattern(spaced, " ")
        coded = lists.values.dictionary_encode()
        pool, begin, size = self._known(coded.dictionary)
        index, edges = coded.indices.to_numpy(), lists.offsets.to_numpy()
        done = np.concatenate([[0], np.cumsum(size[index])])
        return pool[spread(begin[index], size[index])], np.diff(done[edges])

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end."""
        ids, count = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        some, owner, held = [], [], 0

        def flush() -> None:
            if some:
                got, many = self._some(some)
                ids.append(got)
                np.add.at(count, owner, many)

        for i, text in enumerate(texts):
            at = 0
            while at < len(text) or not at:
                cut = text.find(" ", at + PART) if len(text) - at > PART else -1
                part = text[at : cut if cut >= 0 else len(text)]
                some.append(part)
                owner.append(i)
                held += len(part)
                at = cut if cut >= 0 else len(text) or 1
                if held >= PART:
                    flush()
                    some, owner, held = [], [], 0
        flush()
        return np.concatenate(ids), np.cumsum(count)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The text of each run of ids."""
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), self.tokens.take(pa.array(ids.astype(np.int64))))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _head(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)


def _ids(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens and ids of every row; with ``decoded``, the text that they decode to as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at = 0
            for some in chunks([t or "" for t in batch.column(len(keep)).to_pylist()]):
                ids, ends = enc.ids_of(some)
                cols = [batch.column(i).slice(at, len(some)) for i in range(len(keep))]
                at += len(some)
                cols += [pa.array(np.diff(ends, prepend=0), pa.int64()), _ids(ids, ends), *([enc.decode(ids, ends).cast(pa.string())] if decoded else [])]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids", *(["decoded"] if decoded else [])])
        tidy()

    return docs.select(*keep, text).mapInArrow(run, _head(docs, keep) + "n_tokens long, ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """``keep`` columns and decoded, the text of the column ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = [np.array(x or [], np.int64) for x in part.column(len(keep)).to_pylist()]
                out = enc.decode(np.concatenate(lists), np.cumsum([len(x) for x in lists])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], out], [*keep, "decoded"])

    return encoded.selectExpr(*(f"`{k}`" for k in keep), "ids as `ids to decode`").mapInArrow(run, _head(encoded, keep) + "decoded string")

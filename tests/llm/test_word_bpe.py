"""BPE with word ends against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenant.llm import queries, wordbpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
_r = random.Random(3)
TEXTS = [
    None, "", " ", "\n\t\r ", "one", "Hello, World's isn't they'll 123", "a<|endoftext|>B<|startoftext|> <|endoftext|><|endoftext|>x", "  lead and trail  \n", "İstanbul ΣΊΣΥΦΟΣ Ǆ", "éa b　c  ! ?",
    "\x1c!\x1d! \x00\x7f", "漢字かな交じり文" * 30, "'s't're've'm'll'd", "<|endoftext", "😀😀 👩‍👩‍👧", "a" * 500 + " " + "ab" * 400 + "!" * 300, "same words here " * 200, "x" * 20_000,
]
TEXTS += ["".join(_r.choice("abc'sthe<|>é中 1!\ń") for _ in range(_r.randrange(200))) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def told(enc, texts):
    ids, ends = enc.ids_of(texts)
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)], enc.decode(ids, ends).to_pylist()


def test_ids_and_texts_are_the_librarys(library):
    texts = [t or "" for t in TEXTS]
    ids, back = told(wordbpe.WordEncoder(PATH), texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids == want and back == [library.decode(x, skip_special_tokens=False) for x in want]


def test_every_character(library):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1 '{chr(c)}s" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert told(wordbpe.WordEncoder(PATH), texts)[0] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_parts_and_a_full_memo_change_nothing(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "PART", 40)
    monkeypatch.setattr(wordbpe, "MEMO", 7)
    monkeypatch.setattr(wordbpe, "CELLS", 50)
    texts = [t or "" for t in TEXTS]
    assert told(wordbpe.WordEncoder(PATH), texts)[0] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_scan_and_heap_agree():
    merges = wordbpe.WordEncoder(PATH).merges
    words = ["".join(_r.choice("abcdeinrst") for _ in range(_r.randint(1, 60))).encode() for _ in range(400)] + [b"aaaa" * 12, b"a"]
    pool, begin, size = merges.merged(pa.array(words, pa.binary()))
    assert all(np.array_equal(pool[b : b + n], merges.heap(w)) for w, b, n in zip(words, begin, size, strict=True))


def test_merges_take_the_leftmost_of_equal_ranks():
    from provenant.llm.bpe import byte_table

    vocab = {c + end: i for i, (c, end) in enumerate((c, end) for end in ("", "$") for c in byte_table())} | {"aa": 512, "aab$": 513}
    merges = wordbpe.Merges(vocab, [("a", "a"), ("aa", "b$")], "$")
    for word, want in ((b"aaab", [512, vocab["a"], vocab["b$"]]), (b"aab", [513]), (b"aaaa", [512, vocab["a"], vocab["a$"]])):
        pool, begin, size = merges.merged(pa.array([word], pa.binary()))
        assert pool[begin[0] : begin[0] + size[0]].tolist() == want == merges.heap(word).tolist()


def test_a_megabyte_without_a_boundary_and_a_long_text(library):
    texts = ["ab" * 250_000, "the cat sat. " * 400_000]
    assert told(wordbpe.WordEncoder(PATH), texts)[0] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="known kind"):
        wordbpe.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_columns_repeated_rows_and_empty_tables(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS[:18])] + [(4, "one", "clash"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    done = wordbpe.encode(docs, PATH, decoded=True)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, list(r.ids), r.decoded) for r in done.collect())
    want = sorted((i is None, i or 0, len(e := library.encode(t or "", add_special_tokens=False).ids), e, library.decode(e, skip_special_tokens=False)) for i, t, _ in rows)
    assert got == want
    again = wordbpe.decode(wordbpe.encode(docs, PATH), PATH)
    assert sorted((r.doc_id or 0, r.decoded) for r in again.collect()) == sorted((i or 0, d) for _, i, _, _, d in want)
    assert wordbpe.encode(docs.where("false"), PATH).count() == 0
    assert wordbpe.encode(docs, PATH, keep=()).columns == ["n_tokens", "ids"]


def test_registered_query(spark, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_wordbpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(got.dtypes)["n_tokens"] == "bigint"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(e := library.encode(t or "", add_special_tokens=False).ids), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))) for i, t in rows]
    assert sorted(map(tuple, got.where("doc_id IS NOT NULL").collect())) == sorted(r for r in want if r[0] is not None)
    assert got.where(F.col("doc_id").isNull()).count() == 1

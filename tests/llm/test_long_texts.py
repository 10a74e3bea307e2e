"""Work in proportion to a text, and the same results however a text is cut."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from provenant.llm import langid, winnow

#: What is to be removed from a page, as one pattern that may take time in proportion to the square of the page.
MARKUP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w{1,8};")
PARTS = [b"<script", b"<style>", b"</script>", b"</SCRIPT  >", b"</style>", b"<!--", b"-->", b"<", b">", b"&amp;", b"&#12;", b"&", b" x ", b"<b>", b"<scripty>", b"-", b"!", b"\n", b"<!-->", b"/"]


def test_markup_as_by_the_pattern():
    r = random.Random(1)
    for _ in range(30_000):
        html = b"".join(r.choice(PARTS) for _ in range(r.randint(0, 12)))
        assert langid.visible(html) == MARKUP.sub(b" ", html), html


@pytest.mark.parametrize("piece", [b"<script x ", b"<!-- x ", b"<", b"<script></script ", b"&abc", b"<style><!--"])
def test_markup_that_never_closes(piece):
    html, began = piece * (5_000_000 // len(piece)), time.perf_counter()
    langid.visible(html)
    assert time.perf_counter() - began < 60


def test_trigrams_are_counted_by_the_megabyte():
    text = "Der schnelle Fuchs, über 12 Zäune; ".encode() * 90_000
    noise = b" " + b" ".join(text.translate(langid._NOISE).split()) + b" "
    code = lambda a, b, c: ((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 18
    want = Counter(code(*noise[i : i + 3]) for i in range(len(noise) - 2))
    got = langid.counted(text)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want
    assert not langid.counted(b"").any() and not langid.counted(b" 1 ").any()


def test_likelihoods_of_texts(spark):
    """The model and the text's part of the evidence from their definitions, in plain loops."""
    said = {"en": ["the cat and the dog", "of the sea"], "de": ["der Hund und die Katze", "über den See"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in said.items() for t in ts)]
    langs, table = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: np.full(langid.BUCKETS, langid.TRIGRAM) for lang in said}
    for _, t, lang in rows:
        counts[lang] += langid.counted(t.encode())
    assert langs == ["de", "en"] and np.allclose(table, [np.log(counts[lang] / counts[lang].sum()) for lang in langs])
    page = "<html><script>der der</script><p>the dog &amp; the sea</p> " + "and the cat " * 20
    seen = langid.evidence(spark.createDataFrame([(1, None, page)], "page_id long, url string, html string"), langs, table, "page_id", "url", "html").first()
    n = langid.counted(MARKUP.sub(b" ", page.encode()))
    assert np.allclose(seen.text, [(np.log(counts[lang] / counts[lang].sum()) * n).sum() * min(1, langid.AS_MANY / n.sum()) for lang in langs])


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    r = random.Random(2)
    texts = [b" ".join(r.choice([b"a", b"bcd", b"efgh" * 9, b"x1-y"]) for _ in range(r.randint(0, 50))) for _ in range(50)]
    whole = winnow.Words(texts).hash
    for block in (7, 16, 1000):
        monkeypatch.setattr(winnow, "BLOCK", block)
        assert np.array_equal(winnow.Words(texts).hash, whole)


def test_parts_hold_every_window():
    r = random.Random(3)
    for most in (1, 10, 50, 1000):
        text = b" ".join(r.choice([b"a", b"Bcd", b"efgh" * 9, b"x1-y"]) for _ in range(60))
        words, windows = text.translate(winnow._LOWER).split(), set()
        for base, part in winnow.parts(text, 9, most):
            own = part.translate(winnow._LOWER).split()
            assert own == words[base : base + len(own)]
            windows |= {base + i for i in range(len(own) - 9)}
        assert windows == set(range(len(words) - 9))


@pytest.mark.parametrize("chunk", [20, 150])
def test_contamination_of_texts_in_parts(spark, chunk, monkeypatch):
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 10, 14, 25, 1)]
    texts = [" ".join([*(r.choice(words) for _ in range(r.randint(0, 60))), *(r.choice(items) for _ in range(r.randint(0, 3))), *(r.choice(words) for _ in range(r.randint(0, 40)))]) for _ in range(60)] + [None, "", items[3] * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    told = lambda: sorted((x.doc_id, x.n_words, x.n_hit, str(x.hit_spans), x["items"]) for x in winnow.contamination(docs, bench).collect())
    whole = told()
    monkeypatch.setattr(winnow, "CHUNK", chunk)
    assert told() == whole and any(x[2] for x in whole)

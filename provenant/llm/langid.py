"""Language of web pages by Bayesian fusion of evidence.

Four sources are combined as log-probabilities of every language: the page's text under hashed byte
trigrams of each language, the language that its markup declares, the suffix of its address (a
country or language code: first path segment of two letters, else a two-letter top-level domain), and a
prior of its host.  What a declaration or a suffix is worth is not assumed but counted: grouped aggregation of the
texts' own posteriors gives how often pages of a language carry each.  Host priors come from the same
posteriors, smoothed towards the registered domain's, and these towards the whole corpus's; a page's
own text is left out of its host's counts, so it isn't used twice.

The trigram model is fitted on at most ``SAMPLE`` labelled documents (those whose ids hash lowest).

Defined cases: a null or empty page has no text evidence and follows its other sources; a null address has
host ''; unknown declarations count as 'other', missing ones as 'none'; repeated rows count as often as they
occur and get the same result; null ids keep their rows; extra columns are ignored; without labelled
documents the language is null; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE, BUCKETS = 4000, 1 << 14
#: Pseudo-counts of a trigram, a declaration or suffix, and a prior's parent; trigrams in a row depend on one another, so a text counts as at most so many.
TRIGRAM, CATEGORY, PARENT, AS_MANY = 0.5, 2.0, 5.0, 40
#: Beyond so many hosts their priors are joined by a shuffle instead of a broadcast.
BROADCAST_HOSTS = 100_000

#: Second-level names under which countries register domains; fixed values.
SHARED = "ac|co|com|edu|go|gob|gouv|gov|gv|ne|net|nom|or|org"

_OPENING = re.compile(rb"(?i)<(?:(script|style)\b|(!--))?|&#?\w{1,8};")
_CLOSING = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style")}
_NOISE = bytes(32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def visible(html: bytes) -> bytes:
    """A page without scripts, styles, comments, tags and character references, each a blank; in time proportional to the page.

    What is opened and never closed again is sought once: from there on no mark of its kind closes.
    """
    out, at, begin = [], 0, 0
    closes: dict[bytes, bool] = {}

    def end_of(kind: bytes, start: int) -> int:
        if not closes.get(kind, True):
            return -1
        if kind in _CLOSING:
            found = _CLOSING[kind].search(html, start)
            end = found.end() if found else -1
        else:
            end = html.find(kind, start)
            end += len(kind) if end >= 0 else 0
        closes[kind] = end >= 0
        return end

    while m := _OPENING.search(html, at):
        end = m.end() if m[0][:1] == b"&" else -1
        if m[1]:
            end = end_of(m[1].lower(), m.end())
        elif m[2]:
            end = end_of(b"-->", m.end())
        if end < 0:
            end = end_of(b">", m.start())
        if end >= 0:
            out += [html[begin : m.start()], b" "]
            begin = at = end
        else:
            at = m.start() + 1
    return b"".join([*out, html[begin:]])


def counted(text: bytes) -> np.ndarray:
    """How often each trigram bucket occurs in a text, a megabyte at a time."""
    raw = np.frombuffer(b" " + b" ".join(text.translate(_NOISE).split()) + b" ", np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw) - 2 if len(raw) > 3 else 0, 1 << 20):
        part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        out += np.bincount((part[:-2] * 0x9E3779B1 ^ part[1:-1] * 0x85EBCA77 ^ part[2:] * 0xC2B2AE3D) >> np.uint32(18), minlength=BUCKETS)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each trigram bucket in each."""
    chosen = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(sample)
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("chosen")).select(F.col(lang).alias("lang"), text).where("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seen[name] = seen.get(name, 0) + counted(t or b"")
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    # a row for each bucket and language at most
    got = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in got})
    counts = np.full((len(langs), BUCKETS), TRIGRAM)
    for r in got:
        counts[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray, id_col: str, url: str, html: str) -> DataFrame:
    """id, host, domain, declared, suffix and text (a log-likelihood for each language) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)", 1)), F.lit(""))
    tags = F.array_join(F.regexp_extract_all(html, F.lit(r"(?i)<html\b[^>]*+"), F.lit(0)), ">")  # whole, however long
    declared = F.lower(F.regexp_extract(tags, r"""(?i)(?:(?<=[\s"'])|(?<=xml:))lang\s*+=\s*+["']?([a-z]{2,3})\b""", 1))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    country = F.regexp_extract("host", r"\.([a-z]{2})$", 1)
    # the pages' own columns may have the names made here
    out = pages.select(F.col(id_col).alias("page"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", host)
    out = out.withColumn("declared", F.when(F.coalesce(declared, F.lit("")) == "", "none").when(declared.isin(*langs), declared).otherwise("other") if langs else F.lit("none"))
    out = out.withColumn("suffix", F.coalesce(F.nullif(path, F.lit("")), F.nullif(country, F.lit("")), F.lit("none")))
    whole, three = F.col("host").rlike(r"^[0-9.]*$"), F.col("host").rlike(rf"\.({SHARED})\.[a-z]{{2}}$")
    out = out.withColumn("domain", F.when(whole, F.col("host")).when(three, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2)))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for h in batch.column(5).cast(pa.binary()):
                n = counted(visible(h.as_py() or b""))
                scores.append((table @ n * min(1.0, AS_MANY / max(1, int(n.sum())))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.list_(pa.float64()))], ["page", "host", "domain", "declared", "suffix", "text"])

    return out.select("page", "host", "domain", "declared", "suffix", "html").mapInArrow(run, f"page {kind}, host string, domain string, declared string, suffix string, text array<double>")


def _softmax(logs: str) -> str:
    return f"transform({logs}, x -> exp(x - array_max({logs})) / aggregate(transform({logs}, y -> exp(y - array_max({logs}))), 0D, (a, y) -> a + y))"


def _sums(column: str, n: int) -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(n)))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id_col``, host, declared, suffix, text_lang (by text alone), lang and confidence of every page."""
    langs, table = train(docs)
    n = len(langs)
    names = F.array(*map(F.lit, langs)) if langs else F.lit(None).cast("array<string>")
    seen = cut(evidence(pages, langs, table, id_col, url, html).withColumn("p", F.expr(_softmax("text"))))
    if not n:
        return seen.select(F.col("page").alias(id_col), "host", "declared", "suffix", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    whole = seen.agg(_sums("p", n).alias("s"), F.count("*").alias("n")).first()
    of_lang = [x or 0.0 for x in whole["s"]]
    base = [(x + 1) / (whole["n"] + n) for x in of_lang]

    def worth(column: str) -> DataFrame:
        """log P(value | language) of the values of a column with few of them."""
        counts = seen.groupBy(column).agg(_sums("p", n).alias("s"), F.count("*").alias("n"))
        share = F.col("n") / float(max(1, whole["n"]))
        return counts.select(F.col(column).alias(f"its {column}"), F.array(*(F.log((F.col("s")[i] + CATEGORY * share) / (of_lang[i] + CATEGORY)) for i in range(n))).alias(f"by_{column}"))

    hosts = seen.groupBy("domain", "host").agg(_sums("p", n).alias("s"), F.count("*").alias("n"))
    domains = hosts.groupBy("domain").agg(_sums("s", n).alias("ds"), F.sum("n").alias("dn"))
    host_counts = cut(hosts.join(domains, "domain").select(F.col("host").alias("its host"), "s", "n", "ds", "dn"))
    if host_counts.count() <= BROADCAST_HOSTS:
        host_counts = F.broadcast(host_counts)
    both = seen.join(host_counts, F.col("host") == F.col("its host"), "left")
    for column in ("declared", "suffix"):  # declarations: one a language and two; suffixes: two letters
        both = both.join(F.broadcast(worth(column)), F.col(column) == F.col(f"its {column}"), "left")
    parent = [(F.col("ds")[i] - F.col("p")[i] + PARENT * base[i]) / (F.col("dn") - 1 + PARENT) for i in range(n)]
    prior = [F.log(F.greatest(F.lit(1e-9), (F.col("s")[i] - F.col("p")[i] + PARENT * parent[i]) / (F.col("n") - 1 + PARENT))) for i in range(n)]
    total = F.array(*(F.col("text")[i] + F.col("by_declared")[i] + F.col("by_suffix")[i] + prior[i] for i in range(n)))
    scored = both.select("page", "host", "declared", "suffix", "p", total.alias("total")).withColumn("q", F.expr(_softmax("total")))

    def best(p: str) -> Column:
        return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))

    return scored.select(F.col("page").alias(id_col), "host", "declared", "suffix", best("p").alias("text_lang"), best("q").alias("lang"), F.round(F.array_max("q"), 6).alias("confidence"))

"""Column expressions over text, JSON anchors and hashes.

Python's white space and digits are Unicode's, Java's are ASCII's unless ``(?U)`` is set, and Python counts four
more control characters as space; the patterns here follow Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space (any Unicode) at either end."""
    return F.regexp_replace(_col(c), rf"^{_SPACE}+|{_SPACE}+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), rf"{_SPACE}+", " "))


def strip_tags(c: Column | str) -> Column:
    """Markup tags become spaces, white space collapses."""
    return collapse(F.regexp_replace(_col(c), "<[^>]+>", " "))


def has_cjk(c: Column | str) -> Column:
    """Whether a CJK unified ideograph occurs."""
    return _col(c).rlike(r"[\x{4e00}-\x{9fff}]")


def sha256(c: Column | str) -> Column:
    """Hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(_col(c), 256)


def text_hash(c: Column | str) -> Column:
    """SHA-256 of a text, '' if it is empty or null."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c == "", F.lit("")).otherwise(sha256(c))


def canonical_json(c: Column | str) -> Column:
    """JSON with null fields kept; fields must be declared in alphabetical order, and numbers below 1e7."""
    return F.to_json(_col(c), {"ignoreNullFields": "false"})


def unit_hash(text: Column | str, anchor_json: Column | str, source_id: Column | str) -> Column:
    """Hash of a content unit: collapsed text, canonical anchor and source id, by line feeds."""
    parts = (collapse(F.coalesce(_col(text), F.lit(""))), F.coalesce(_col(anchor_json), F.lit("")), F.coalesce(_col(source_id), F.lit("")))
    return sha256(F.concat_ws("\n", *parts))


def evidence_hash(quote: Column | str, unit: Column | str, anchor_json: Column | str) -> Column:
    """Hash of a citation: quote, unit hash and canonical anchor, by line feeds."""
    return sha256(F.concat_ws("\n", *(F.coalesce(_col(c), F.lit("")) for c in (quote, unit, anchor_json))))


def stable_id(*parts: Column | str) -> Column:
    """A deterministic id of its parts."""
    return sha256(F.concat_ws("\x00", *(F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts)))


def like_any(c: Column | str, keywords: list[str], raw: bool = False) -> Column:
    """Whether any keyword occurs, in either case; ``raw`` leaves % and _ as wildcards."""
    out = F.lit(False)
    for k in keywords:
        out = out | (_col(c).ilike(f"%{k}%") if raw else F.contains(F.lower(_col(c)), F.lit(k.lower())))
    return out


def hit_count(c: Column | str, keywords: list[str]) -> Column:
    """How many of the keywords occur, in either case."""
    low = F.lower(_col(c))
    return sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))


def preview(c: Column | str, n: int) -> Column:
    """The first n characters."""
    return F.substring(_col(c), 1, n)


def token_estimate(c: Column | str) -> Column:
    """Half the characters and one."""
    return F.floor(F.length(_col(c)) / 2).cast("int") + 1


def numbers(c: Column | str, pattern: str) -> Column:
    """All numbers that the pattern's first group matches, as ints; full-width digits count."""
    found = F.regexp_extract_all(_col(c), F.lit(f"(?U){pattern}"), 1)
    return F.transform(found, lambda x: F.translate(x, "０１２３４５６７８９", "0123456789").try_cast("int"))


def _doubles(c: Column | str) -> Column:
    return F.transform(_col(c), lambda v: v.cast("double"))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))


def with_norm(df: DataFrame, vector: str, norm: str) -> DataFrame:
    """The rows with a vector in double precision and its length, so that pairs need not make either again."""
    return df.withColumn(vector, _doubles(vector)).withColumn(norm, _norm(F.col(vector)))


def cosine_of(a: Column | str, b: Column | str, size: Column) -> Column:
    """Cosine similarity of vectors in double precision whose lengths multiply to ``size``; 0 where that is 0, an error where dimensions differ."""
    dot = F.aggregate(F.zip_with(_col(a), _col(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    safe = F.when(size == 0, F.lit(0.0)).otherwise(dot / size)
    return F.when(F.size(_col(a)) == F.size(_col(b)), safe).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; 0 where a norm is 0, an error where lengths differ."""
    x, y = _doubles(a), _doubles(b)
    return cosine_of(x, y, _norm(x) * _norm(y))


def risk_rank(c: Column | str) -> Column:
    """low 0, medium 1, high 2; anything else counts as medium."""
    return F.when(_col(c) == "low", 0).when(_col(c) == "high", 2).otherwise(1)


def worst_risk(a: Column | str, b: Column | str) -> Column:
    """The worse of two levels; the first at a tie."""
    return F.when(risk_rank(b) > risk_rank(a), _col(b)).otherwise(_col(a))


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Held within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), _col(c)))


def is_bbox(c: Column | str) -> Column:
    """An array of four non-null numbers."""
    return F.coalesce((F.size(_col(c)) == 4) & ~F.exists(_col(c), lambda v: v.isNull()), F.lit(False))

"""Personal data by candidate gradient boosting, with DataFrame functions only on the main path.

Base spans are e-mail addresses, IPv4 addresses, payment cards and international phone numbers of four
fixed patterns with their checks.  High-recall generators then propose further spans, which may overlap:
national ids, local phone numbers, IBANs, spelt-out e-mail addresses, IPv6 addresses and card-like
numbers.  Boosted trees score each from its format and its context.  The model is small and fitted on
the driver from ``EXAMPLES`` generated sentences (candidates are found in them by the same expressions),
calibrated by a logistic fit on a second part of them, and written out as one SQL expression;
for each kind the least threshold that reaches ``PRECISION`` on a third part selects what counts.
Base spans always stay; a selected candidate that meets a base span adds nothing.  Selected candidates may overlap one
another: each is listed, and redaction covers their union.

The patterns never backtrack over more than a bounded length: separators inside a number, or dots inside a
domain, are first marked one by one, so that each match is a run of one class of characters.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole; repeated rows
give repeated spans; extra columns are ignored or, in ``redact``, kept; an empty table gives an empty
table.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import Trees, fit
from .spans import apart, between, blocks_of, bound, clean, located, masked, pieces

#: Kinds of base spans in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
EXAMPLES, PRECISION = 3000, 0.97
#: Private characters that stand for a dot in a domain and a separator in a number; a text's own are replaced first.
DOT, GAP, OWN = "\ue000", "\ue001", "\x02"

EMAIL = rf"(?:(?<![A-Za-z0-9._%+\-{DOT}])|\G)[A-Za-z0-9._%+\-{DOT}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9\-{DOT}]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
NUMBER = rf"[0-9][0-9{GAP}]{{12,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_H = "[0-9A-Fa-f]{1,4}"
#: Generators: name, pattern, what a text must hold for it.
GENERATORS = (
    ("national", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "_text RLIKE '[0-9]-[0-9]'"),
    ("local_phone", r"(?<![0-9A-Za-z+.,$])\(?[0-9]{2,5}\)?[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,5}){0,3}(?![0-9A-Za-z])", "_text RLIKE '[0-9][ ./)-]+[0-9]'"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "_text RLIKE '[A-Z][0-9][0-9]'"),
    ("email_at", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,5}", "_text RLIKE '[(\\\\[]at[)\\\\]]'"),
    ("ipv6", rf"(?<![0-9A-Za-z:])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{1,7}}:|:(?::{_H}){{1,7}})(?![0-9A-Za-z:])", "contains(_text, '::') OR _text RLIKE ':[0-9A-Fa-f]{1,4}:'"),
)
ORDER = {k: i for i, k in enumerate((*KINDS, *(g[0] for g in GENERATORS), "long_number"))}

_GOOD = "(tel|phone|call|mobile|cell|fax|telefon|llam|appel|contact|kontakt|ssn|social|passport|iban|konto|account|compte|cuenta|bank|mail|write to|host|address|card|karte|carte)"
_BAD = "(order|invoice|version|page|isbn|issn|ref|price|total|sum|year|chapter|date|sku|score|between|section|table|release|build|serial|model)"
FEATURES = ("kind", "chars", "digits", "letters", "groups", "distinct", "good", "bad", "money", "year", "date", "decimal", "luhn", "mod97", "touches", "tens")

_DIGITS = "regexp_replace(c.hit, '[^0-9]', '')"
_LUHN = """(aggregate(transform(sequence(1, greatest(1, length({d}))), i -> named_struct('v', coalesce(try_cast(substring(reverse({d}), i, 1) AS int), 0), 'e', i % 2 = 0)), 0,
  (a, x) -> a + CASE WHEN NOT x.e THEN x.v WHEN x.v > 4 THEN 2 * x.v - 9 ELSE 2 * x.v END) % 10 = 0)"""
_MOD97 = """(aggregate(filter(split(concat(substring(replace(c.hit, ' ', ''), 5), substring(replace(c.hit, ' ', ''), 1, 4)), ''), x -> x <> ''), 0,
  (a, x) -> CASE WHEN x RLIKE '[0-9]' THEN (a * 10 + CAST(x AS int)) % 97 ELSE (a * 100 + ascii(x) - 55) % 97 END) = 1)"""


def luhn(digits: str) -> str:
    """SQL: whether a string of digits has a valid check digit."""
    return _LUHN.format(d=digits)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _text, _base (the base spans, with their text) and _numbers (card-like numbers that fail the check)."""
    out = docs.withColumn("_text", F.replace(F.replace(clean(F.col(text)), F.lit(DOT), F.lit(OWN)), F.lit(GAP), F.lit(OWN)))

    def where(needs: str, column: Column) -> Column:
        return F.when(F.expr(needs), column).otherwise(F.array(F.lit("")))

    dotted = F.regexp_replace("_text", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    gapped = F.regexp_replace("_text", r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
    out = out.withColumn("_email_parts", where("contains(_text, '@')", pieces(dotted, EMAIL)))
    out = out.withColumn("_ip_parts", where("_text RLIKE '[0-9][.][0-9]'", pieces(F.col("_text"), IP)))
    out = out.withColumn("_card_parts", where("_text RLIKE '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", pieces(gapped, NUMBER)))
    out = out.withColumn("_phone_parts", where("contains(_text, '+')", pieces(F.col("_text"), PHONE)))
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", F.expr(located(f"_{kind}_parts"))).drop(f"_{kind}_parts")
    out = out.withColumn("_ip", F.expr("filter(_ip, c -> forall(split(c.hit, '[.]'), p -> p RLIKE '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$'))"))
    out = out.withColumn("_card", F.expr(f"transform(_card, c -> named_struct('start', c.start, 'end', c.end, 'hit', {_DIGITS}))"))
    out = out.withColumn("_card", F.expr(f"transform(filter(_card, c -> length(c.hit) BETWEEN 13 AND 19), c -> named_struct('start', c.start, 'end', c.end, 'hit', c.hit, 'ok', {luhn('c.hit')}))"))
    out = out.withColumn("_phone", F.expr(f"filter(_phone, c -> length({_DIGITS}) BETWEEN 9 AND 15)"))
    out = out.withColumn("_numbers", F.expr("transform(filter(_card, c -> NOT c.ok), c -> named_struct('start', c.start, 'end', c.end, 'hit', c.hit))")).withColumn("_card", F.expr("filter(_card, c -> c.ok)"))
    every = ", ".join(f"transform(_{k}, s -> named_struct('order', {ORDER[k]}, 'start', s.start, 'end', s.end, 'kind', '{k}'))" for k in KINDS)
    return out.withColumn("_base", F.expr(f"array_sort(concat({every}))")).drop(*(f"_{k}" for k in KINDS))


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (of ``with_base``) with _found: order, start, end, kind and x (the features) of each candidate that meets no base span."""
    out = docs
    for kind, pattern, needs in GENERATORS:
        out = out.withColumn(f"_{kind}", F.when(F.expr(needs), pieces(F.col("_text"), pattern)).otherwise(F.array(F.lit("")))).withColumn(f"_{kind}", F.expr(located(f"_{kind}")))
    names = [g[0] for g in GENERATORS]
    every = [f"transform(_{k}, c -> named_struct('order', {ORDER[k]}, 'start', c.start, 'end', c.end, 'kind', '{k}', 'hit', c.hit))" for k in names]
    every.append(f"transform(_numbers, c -> named_struct('order', {ORDER['long_number']}, 'start', c.start, 'end', c.end, 'kind', 'long_number', 'hit', c.hit))")
    out = out.withColumn("_found", F.expr(apart(f"concat({', '.join(every)})", "_base")))
    around = f"'before', lower({between('greatest(c.start - 24, 0)', 'c.start')}), 'after', {between('c.end', 'c.end + 3')}"
    out = out.withColumn("_found", F.expr(bound("blocks", "CASE WHEN size(_found) > 0 THEN " + blocks_of("_text") + " END", f"transform(_found, c -> named_struct('order', c.order, 'start', c.start, 'end', c.end, 'kind', c.kind, 'hit', c.hit, {around}))")))
    x = {
        "kind": "c.order",
        "chars": "length(c.hit)",
        "digits": f"length({_DIGITS})",
        "letters": "length(regexp_replace(c.hit, '[^A-Za-z]', ''))",
        "groups": "size(split(c.hit, '[^0-9A-Za-z]+'))",
        "distinct": f"size(array_distinct(split({_DIGITS}, '')))",
        "good": f"c.before RLIKE '{_GOOD}'",
        "bad": f"c.before RLIKE '{_BAD}'",
        "money": "c.before RLIKE '[$€£#=]\\\\s?$' OR c.after RLIKE '^\\\\s?([€$%]|eur|usd)'",
        "year": "c.hit RLIKE '^(19|20)[0-9]{2}[^0-9]'",
        "date": "c.hit RLIKE '^([0-9]{1,2}[./-][0-9]{1,2}[./-]([0-9]{2}|[0-9]{4})|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})$'",
        "decimal": "c.hit RLIKE '^[0-9]+[.][0-9]+$'",
        "luhn": luhn(_DIGITS),
        "mod97": f"c.kind = 'iban' AND {_MOD97}",
        "touches": "c.before RLIKE '[0-9A-Za-z]$' OR c.after RLIKE '^[0-9A-Za-z]'",
        "tens": f"length({_DIGITS}) BETWEEN 7 AND 11",
    }
    values = ", ".join(f"CAST({x[f]} AS double)" for f in FEATURES)
    return out.withColumn("_found", F.expr(f"transform(_found, c -> named_struct('order', c.order, 'start', c.start, 'end', c.end, 'kind', c.kind, 'x', array({values})))")).drop(*(f"_{k}" for k in names), "_numbers")


def examples(n: int = EXAMPLES, seed: int = 7) -> list[dict]:
    """Sentences with one number or address each: text, and y whether it is personal; the same for the same seed."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    sep = lambda: r.choice(" -./")

    def iban() -> str:
        country, body = r.choice(["DE", "FR", "ES", "GB"]), digits(18)
        number = int("".join(str(int(c, 36)) for c in body + country + "00"))
        whole = country + f"{98 - number % 97:02d}" + body
        return whole if r.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def local() -> str:
        s = sep()
        return r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{s}{digits(3)}{s}{digits(4)}", f"0{digits(3)}/{digits(5)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"])

    name = lambda: "".join(r.choice("aeiourstnlm") for _ in range(r.randint(3, 8)))
    yes = [
        (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["ssn", "my social number is", "id", "passport"]),
        (local, ["tel", "call me at", "phone:", "mobile", "Telefon", "fax", "contact"]),
        (iban, ["IBAN", "my account", "bank account", "Konto", "compte"]),
        (lambda: f"{name()}{r.choice([' (at) ', '(at)', ' [at] '])}{name()}{r.choice(['.', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net'])}", ["write to", "mail", "contact"]),
        (lambda: ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8)), ["host", "address", "from"]),
        (lambda: f"2001:{r.randrange(1 << 16):x}::{r.randrange(1 << 16):x}{r.choice(['', f':{r.randrange(1 << 16):x}'])}", ["host", "address", "from"]),
        (lambda: digits(r.randint(13, 19)), ["account", "my account", "Konto", "compte", "cuenta", "card", "bank"]),
    ]
    no = [
        (lambda: f"{r.randint(1, 31):02d}{(s := r.choice('./-'))}{r.randint(1, 12):02d}{s}{r.randint(1950, 2030)}", ["on", "date", "of", "since"]),
        (lambda: f"{r.randint(1950, 2030)}-{r.randint(1950, 2030)}", ["between", "years", "from"]),
        (lambda: f"{digits(r.randint(2, 4))}.{digits(2)}", ["price", "total", "about", "score"]),
        (lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", ["ISBN", "book"]),
        (lambda: f"{digits(2)}.{digits(2)}.{digits(2)}", ["version", "release", "section"]),
        (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", ["order", "invoice", "sku", "serial"]),
        (lambda: f"{digits(3)} {digits(3)} {digits(3)}", ["total", "sum", "price", "about"]),
        (lambda: f"{r.choice(['AB', 'XK', 'QZ'])}{digits(2)}{digits(12)}", ["model", "serial", "order", "ref"]),
        (lambda: digits(r.randint(13, 19)), ["order", "ref", "serial", "number"]),
        (lambda: f"{digits(4)} {digits(4)}", ["table", "page", "of", "model"]),
        (lambda: f"{r.choice(['ab', 'cafe', 'bad', 'ace'])}::{r.choice(['add', 'dead', 'be', 'fad'])}", ["class", "module", "calls", "release"]),
    ]
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    out = []
    for _ in range(n):
        y = r.random() < 0.5
        make, leads = r.choice(yes if y else no)
        lead = r.choice(leads) if r.random() < 0.85 else word()
        out.append({"text": f"{word()} {word()} {lead} {make()} {word()} {word()}", "y": int(y)})
    return out


class Model:
    """Trees, the calibration of their margins (slope, shift), and the least chance of each kind that selects."""

    def __init__(self, trees: Trees, slope: float, shift: float, least: dict[str, float]):
        self.trees, self.slope, self.shift, self.least = trees, slope, shift, least

    def sql(self, x: str = "c.x") -> str:
        """The calibrated chance as SQL over an array of features."""
        t = self.trees

        def node(k: int) -> str:
            if t.left[k] < 0:
                return f"{float(t.value[k])!r}D"
            return f"CASE WHEN {x}[{int(t.feature[k])}] <= {float(t.edge[k])!r}D THEN {node(int(t.left[k]))} ELSE {node(int(t.left[k]) + 1)} END"

        margin = " + ".join([f"{t.base!r}D", *(node(int(k)) for k in t.root)])
        return f"1 / (1 + exp(-({self.slope!r}D * ({margin}) + {self.shift!r}D)))"


def train(spark: SparkSession, n: int = EXAMPLES) -> Model:
    """The model of the generated examples: a half fits the trees, a quarter calibrates, a quarter sets thresholds."""
    rows = F.from_json(F.lit(json.dumps(examples(n))), "array<struct<text: string, y: int>>")
    texts = spark.range(1).select(F.explode(rows).alias("e")).select("e.text", "e.y", F.xxhash64("e.text").alias("h"))
    got = with_candidates(with_base(texts, "text")).select("h", "y", F.explode("_found").alias("c")).select("h", "y", "c.kind", "c.x").collect()  # of n sentences
    got.sort(key=lambda r: (r["h"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    part = np.array([r["h"] % 4 for r in got])
    trees = fit(x[part < 2], y[part < 2], trees=24, depth=3, rate=0.3)
    margin = np.log(trees.score(x) / np.maximum(1e-12, 1 - trees.score(x)))
    slope, shift, m, z = 1.0, 0.0, margin[part == 2], y[part == 2]
    for _ in range(50):  # Newton steps of the logistic fit, held back a little
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        w = p * (1 - p) + 1e-6
        hessian = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        slope, shift = np.array([slope, shift]) + np.linalg.solve(hessian, [((z - p) * m).sum() - (slope - 1), (z - p).sum() - shift])
    chance = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
    least, kinds = {}, np.array([r["kind"] for r in got])
    for kind in ORDER:
        if kind in KINDS:
            continue
        p, t = chance[(part == 3) & (kinds == kind)], y[(part == 3) & (kinds == kind)]
        order = np.argsort(-p)
        right = np.cumsum(t[order]) / np.arange(1, len(p) + 1)
        enough = np.flatnonzero(right >= PRECISION)
        least[kind] = max(0.5, float(p[order][enough[-1]])) if len(enough) else 2.0
    return Model(trees, float(slope), float(shift), least)


def with_spans(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (order, start, end, kind) by kind as listed, then start."""
    model = model or train(docs.sparkSession)
    own = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"own {i}") for i, c in enumerate(own)), F.col(text).alias("_given"))
    inner = with_candidates(with_base(inner, "_given"))
    least = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in model.least.items()) + " END"
    chosen = f"transform(filter(_found, c -> {model.sql()} >= {least}), c -> named_struct('order', c.order, 'start', c.start, 'end', c.end, 'kind', c.kind))"
    inner = inner.withColumn("_all", F.expr(f"array_sort(concat(_base, {chosen}))"))
    return inner.select(*(F.col(f"own {i}").alias(c) for i, c in enumerate(own)), F.col("_base").alias("base_spans"), F.col("_all").alias("spans"))


def redact(docs: DataFrame, text: str = "text", by: str = "[PRIVATE]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``by``."""
    own = docs.columns
    found = with_spans(docs.select(*(F.col(f"`{c}`").alias(f"doc {i}") for i, c in enumerate(own)), F.col(text).alias("scanned")), "scanned")
    found = found.withColumn("ordered", F.expr("array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end)))"))
    return found.select(*((F.expr(masked("scanned", "ordered", by)) if c == text else F.col(f"doc {i}")).alias(c) for i, c in enumerate(own)))

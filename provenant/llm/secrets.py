"""Secret scans: known forms, and a battery of randomness tests over token-like runs.

Base spans are the assignments, access keys and long hex strings of three fixed patterns.  The method
adds ``random`` spans: runs of 20 and more characters of the usual encodings, outside base spans; an equals
sign ends a run, of which it is padding at most.  Names and paths run on into the values behind them, so a run
with a slash, underscore or hyphen is also tried in its parts of 20 and more characters.  For
each of these the encoding is inferred (hex, base26 of one case, base32, base36, base62, base64); plain digits, which
have no ordinary form to be told from, and a capital before small letters, which is a word, are left out.

The battery has three tests of randomness in the encoding's alphabet: chi-squared uniformity, runs above
and below the middle of the alphabet, and serial correlation at lag one; its chance is three times the
least of theirs.  It says how well random symbols explain a run, but short words pass it too.  So each run also has
the chance that ordinary text (words, identifiers) looks as random: its repeats are as few, and its
changes between lower case, upper case and digits (not at the beginnings of words) as many.  Both go through the weighted
Benjamini-Hochberg rule at rate ``RATE`` over all documents, separately for each class of length, from a histogram of
fixed size: the second chance divided by a weight, which is the first, or nothing where that is below ``ALPHA``.
Thus a run is a discovery only if text explains it far worse than random symbols do, and never if it fails any one
test outright.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole; repeated
rows give repeated spans (and count as often in the histogram); extra columns are ignored or, in
``redact``, kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import apart, bound, clean, located, masked, pieces, running, total, upper_tail

#: The base patterns, kinds in the order of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: What lower-cased texts with an assignment hold.
NAMED = ("passw", "secret", "token", "api")

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"  # looking back spares a try at every character of a word
#: A run is tried whole, then in the parts between these; a part counts where nothing before it was found.
WAYS = ("/", "[_-]", "[/_-]")
ALPHA, RATE = 0.001, 0.01
TESTS = ("even", "runs", "serial")
#: Of ordinary text: chance that two symbols are equal, that three are, and that the class of character changes from one to the next.
SAME_TWO, SAME_THREE, CHANGE = 0.065, 0.0055, 0.15
#: Classes of length begin here; chances are counted by tenths of a decade up to 1e-40.
LENGTHS = (20, 32, 64, 128)
BINS = 400

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order of inference: name, pattern of the run, alphabet.
ENCODINGS = (
    ("digits", "[0-9]+", None),
    ("word", "[A-Z][a-z]+", None),
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("lower", "[a-z]+", _LOWER),
    ("upper", "[A-Z]+", _UPPER),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("base36", "[a-z0-9]+", _DIGITS + _LOWER),
    ("base62", "[A-Za-z0-9]+", _DIGITS + _UPPER + _LOWER),
    ("base64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
)


def _case(pick) -> str:
    return "CASE c.kind " + " ".join(f"WHEN '{name}' THEN {pick(alphabet)}" for name, _, alphabet in ENCODINGS if alphabet) + " END"


def with_runs(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _runs: start, end, n, p_random (the battery's chance), p_text (that of text) and p (the latter, weighted) of each run with an inferred encoding, by start."""
    kind = "CASE " + " ".join(f"WHEN c.core RLIKE '^({p})$' THEN '{name}'" for name, p, _ in ENCODINGS) + " ELSE 'none' END"
    classes = "l" * 26 + "u" * 26 + "d" * 10  # signs vanish, as between the words of a name, and a capital before a small letter is one, as at a word's beginning
    middle = _case(lambda a: f"translate(c.core, '{a}', '{'0' * (len(a) // 2) + '1' * (len(a) - len(a) // 2)}')")
    place = _case(lambda a: f"transform(c.symbols, x -> CAST(instr('{a}', x) AS double))")

    def parts(way: int, at: str) -> str:
        begins = running("transform(ps, p -> length(p) + 1)", total)
        one = f"named_struct('start', c.start + at, 'end', CASE WHEN at + length(p) = length(c.core) THEN c.end ELSE c.start + at + length(p) END, 'way', {way}, 'core', p)"
        return bound("ps", f"split(c.core, '{at}')", f"filter(zip_with(ps, {begins}, (p, at) -> {one}), p -> length(p.core) BETWEEN {LENGTHS[0]} AND length(c.core) - 1)")

    every = ", ".join(parts(way, at) for way, at in enumerate(WAYS, 1))
    chances = {"even": upper_tail("c.z_even"), "runs": f"2 * {upper_tail('c.z_runs')}", "serial": f"2 * {upper_tail('c.z_serial')}"}
    steps = [
        ("_parts", pieces(clean(F.col(text)), RUN)),
        ("_runs", F.expr(located("_parts"))),
        ("_runs", F.expr("transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', 0, 'core', rtrim('=', c.hit)))")),
        ("_runs", F.expr(f"array_sort(flatten(transform(_runs, c -> CASE WHEN c.core RLIKE '[/_-]' THEN concat(array(c), {every}) ELSE array(c) END)))")),
        # a part of several ways counts once
        ("_runs", F.expr(bound("rs", "_runs", "filter(rs, (c, i) -> i = 0 OR rs[greatest(i - 1, 0)].start <> c.start OR rs[greatest(i - 1, 0)].end <> c.end)"))),
        ("_runs", F.expr(f"filter(transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', c.way, 'core', c.core, 'n', CAST(length(c.core) AS double), 'kind', {kind})), c -> c.n >= {LENGTHS[0]} AND c.kind NOT IN ('digits', 'word', 'none'))")),
        ("_runs", F.expr("transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', c.way, 'core', c.core, 'n', c.n, 'kind', c.kind, 'symbols', filter(split(c.core, ''), x -> x <> '')))")),
        (
            "_runs",
            F.expr(
                f"""transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', c.way, 'n', c.n, 'one', c.kind IN ('lower', 'upper'), 'k', CAST({_case(lambda a: str(len(a)))} AS double),
                'squares', aggregate(array_distinct(c.symbols), 0D, (a, x) -> a + pow(c.n - length(replace(c.core, x, '')), 2)),
                'changes', length(regexp_replace(regexp_replace(translate(c.core, '{_LOWER + _UPPER + _DIGITS}+/_-', '{classes}'), 'u(?=l)', 'l'), 'l+|u+|d+', 'x')) - 1,
                'middle', {middle}, 'place', {place}))"""
            ),
        ),
        (
            "_runs",
            F.expr(
                """transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', c.way, 'n', c.n, 'one', c.one, 'k', c.k, 'squares', c.squares, 'changes', c.changes,
                'ones', c.n - length(replace(c.middle, '1', '')), 'runs', length(regexp_replace(c.middle, '0+|1+', 'x')),
                'mean', aggregate(c.place, 0D, (a, x) -> a + x) / c.n, 'place', c.place))"""
            ),
        ),
        (
            "_runs",
            F.expr(
                """transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', c.way, 'n', c.n, 'one', c.one, 'k', c.k, 'squares', c.squares, 'changes', c.changes, 'ones', c.ones, 'runs', c.runs,
                'about', 1 + 2 * c.ones * (c.n - c.ones) / c.n,
                'power', aggregate(c.place, 0D, (a, x) -> a + (x - c.mean) * (x - c.mean)),
                'lagged', aggregate(zip_with(slice(c.place, 1, size(c.place) - 1), slice(c.place, 2, size(c.place) - 1), (x, y) -> (x - c.mean) * (y - c.mean)), 0D, (a, x) -> a + x)))"""
            ),
        ),
        (
            "_runs",
            F.expr(
                f"""transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', c.way, 'n', c.n, 'one', c.one,
                'z_even', (pow((c.k / c.n * c.squares - c.n) / (c.k - 1), 1 / 3D) - (1 - 2 / (9 * (c.k - 1)))) / sqrt(2 / (9 * (c.k - 1))),
                'z_runs', CASE WHEN c.about < 3 THEN 9D ELSE abs(c.runs - c.about) / sqrt((c.about - 1) * (c.about - 2) / (c.n - 1)) END,
                'z_serial', CASE WHEN c.power = 0 THEN 9D ELSE abs(c.lagged / c.power + 1 / c.n) * sqrt(c.n) END,
                'z_pairs', ({SAME_TWO} * c.n * (c.n - 1) / 2 - (c.squares - c.n) / 2) / sqrt(c.n * (c.n - 1) / 2 * {SAME_TWO} * (1 - {SAME_TWO}) + c.n * (c.n - 1) * (c.n - 2) * {SAME_THREE - SAME_TWO**2}),
                'z_changes', (c.changes - {CHANGE} * (c.n - 1)) / sqrt({CHANGE * (1 - CHANGE)} * (c.n - 1))))"""
            ),
        ),
        (
            "_runs",
            F.expr(
                f"""transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', c.way, 'n', c.n,
                'p_random', least(1D, {len(TESTS)} * least(1D, {', '.join(chances[t] for t in TESTS)})),
                'p_text', CASE WHEN c.one THEN {upper_tail('c.z_pairs')} ELSE {upper_tail('((greatest(c.z_pairs, -1D) + c.z_changes) / sqrt(2D))')} END))"""
            ),
        ),
        ("_runs", F.expr(f"transform(_runs, c -> named_struct('start', c.start, 'end', c.end, 'way', c.way, 'n', c.n, 'p_random', c.p_random, 'p_text', c.p_text, 'p', CASE WHEN c.p_random < {ALPHA} THEN 1D ELSE least(1D, c.p_text / c.p_random) END))")),
    ]
    for name, step in steps:
        docs = docs.withColumn(name, step)
    return docs.drop("_parts")


def _class(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {least} THEN {i}" for i, least in reversed(list(enumerate(LENGTHS)))) + " ELSE 0 END"


def thresholds(docs: DataFrame, text: str = "text", rate: float = RATE) -> list[float]:
    """For each class of length the greatest chance that is still a discovery (0: none is)."""
    runs = with_runs(docs.select(F.col(text).alias("text")), "text").select(F.explode_outer("_runs").alias("r")).where("r IS NOT NULL")  # outer: no filter on the runs is carried below the steps that make them
    binned = runs.select(F.expr(_class("r.n")).alias("length"), F.expr(f"CAST(least({BINS}, greatest(0, floor(-10 * log10(greatest(r.p, 1e-300D))))) AS int)").alias("bin"))
    counts = [[0] * (BINS + 1) for _ in LENGTHS]
    for r in binned.groupBy("length", "bin").count().collect():  # at most len(LENGTHS) * (BINS + 1) rows
        counts[r["length"]][r["bin"]] = r["count"]
    out = []
    for row in counts:
        total, seen, best = sum(row), 0, 0.0
        for b in range(BINS, -1, -1):
            seen += row[b]
            if seen and 10 ** (-b / 10) <= rate * seen / total:
                best = 10 ** (-b / 10)
        out.append(best)
    return out


def with_spans(docs: DataFrame, text: str = "text", limits: list[float] | None = None) -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (start, order, end, kind) by start, then kind as listed."""
    limits = thresholds(docs, text) if limits is None else limits
    own = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"own {i}") for i, c in enumerate(own)), clean(F.col(text)).alias("_text"))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        parts = pieces(F.col("_text"), pattern)
        if kind == "assign":
            parts = F.when(F.expr(bound("low", "lower(_text)", " OR ".join(f"contains(low, '{n}')" for n in NAMED))), parts).otherwise(F.array(F.lit("")))
        inner = inner.withColumn(f"_{kind}_parts", parts).withColumn(f"_{kind}", F.expr(located(f"_{kind}_parts")))
    inner = inner.withColumn("_assign", F.filter("_assign", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 8))
    inner = with_runs(inner, "_text")
    struct = "named_struct('start', s.start, 'order', {0}, 'end', s.end, 'kind', '{1}')"
    base = "concat(" + ", ".join(f"transform(_{k}, s -> {struct.format(i, k)})" for i, k in enumerate(KINDS[:3])) + ")"
    limit = "CASE " + " ".join(f"WHEN s.n >= {least} THEN {limits[i]!r}D" for i, least in reversed(list(enumerate(LENGTHS)))) + " ELSE 0D END"
    inner = inner.withColumn("_base", F.expr(f"array_sort({base})"))
    inner = inner.withColumn("_likely", F.expr(f"filter(_runs, s -> s.p <= {limit})"))
    inner = inner.withColumn("_random", F.expr(apart("_likely", "_base"))).withColumn("_found", F.expr("filter(_random, s -> s.way = 0)"))
    for way in range(1, len(WAYS) + 1):
        inner = inner.withColumn("_part", F.expr(f"filter(_random, s -> s.way = {way})")).withColumn("_found", F.expr(f"concat(_found, {apart('_part', '_found')})"))
    inner = inner.withColumn("_all", F.expr(f"array_sort(concat(_base, transform(_found, s -> {struct.format(3, 'random')})))"))
    return inner.select(*(F.col(f"own {i}").alias(c) for i, c in enumerate(own)), F.col("_base").alias("base_spans"), F.col("_all").alias("spans"))


def redact(docs: DataFrame, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``by``; a column n_chars follows the new text."""
    own = docs.columns
    found = with_spans(docs.select(*(F.col(f"`{c}`").alias(f"doc {i}") for i, c in enumerate(own)), F.col(text).alias("scanned")), "scanned")
    new = F.expr(f"CASE WHEN size(spans) = 0 THEN scanned ELSE {masked('scanned', 'spans', by)} END")
    out = {c: F.col(f"doc {i}") for i, c in enumerate(own)}
    out[text] = new
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("spans") == 0, out["n_chars"]).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return found.select(*(v.alias(c) for c, v in out.items()))

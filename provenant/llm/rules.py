"""Quality rules as a short-circuit cascade, with DataFrame functions only.

The base counts are made for every text.  The method's own rules form a cascade: on a sample drawn from the
whole table each rule's cost is the time of evaluating it alone, over so many copies of the sample that the time
of the same job without a rule can be taken off it (the median of some runs each), and its selectivity is the
share of texts that it rejects.  The first rule of the cascade is the one with the most rejections per cost; each next one
has the most among the texts that the rules before it accept, and where none are left the cheaper comes first.  A
text is kept if all rules accept it; evaluation of a row stops at the first that does not.  The order
changes only the work, never the verdict.

Defined cases: a null or word-less text has counts of zero and fails the base rule of ten words;
texts of any length are counted whole; repeated rows give repeated results; extra columns are
ignored; with an empty table the cascade keeps its written order.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import bound

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Texts (about) that costs and selectivities are estimated on, copies of them that are timed, and runs of each timing.
SAMPLE, COPIES, RUNS = 1000, 8, 3


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _text, _words, _lines and the base counts."""
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    spaced = "_text"
    for code in range(9, 14):  # every white space as a blank: the split then needs no pattern
        spaced = f"replace({spaced}, chr({code}), ' ')"
    out = out.withColumn("_words", F.expr(f"filter(split({spaced}, ' '), w -> w <> '')"))
    out = out.withColumn("_lines", F.expr("filter(split(_text, '\n'), l -> l RLIKE r'[^\x20\x09-\x0D]')"))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length("_text") - F.length(F.regexp_replace("_text", f"[{SYMBOLS}]+", ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # a window found twice makes WINDOW - 1 pairs of words that were there before; with fewer no window is looked at
    pairs = "zip_with(slice(h, 1, greatest(size(h) - 1, 0)), slice(h, 2, greatest(size(h) - 1, 0)), (a, b) -> xxhash64(a, b))"
    again = bound("p", pairs, f"size(p) - size(array_distinct(p)) >= {WINDOW - 1}")
    grams = f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(WINDOW))}))"
    twice = "array_sort(transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].g = x.g) OR (k < size(s) - 1 AND s[k + 1].g = x.g)), x -> x.i))"
    covered = f"aggregate(t, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct('n', a.n + i + {WINDOW} - greatest(a.end, i), 'end', i + {WINDOW}), a -> a.n)"
    repeated = bound("s", "array_sort(transform(g, (x, i) -> named_struct('g', x, 'i', i)))", bound("t", twice, covered))
    counted = bound("g", grams, f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {repeated} END")
    out = out.withColumn("n_repeat_words", F.expr(bound("h", "_hashes", f"CASE WHEN size(h) > {WINDOW} AND {again} THEN {counted} ELSE 0L END")))
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


#: The method's rules: each accepts a text (all have words, as the base rules come first).
RULES: dict[str, str] = {
    "symbols": "10 * n_symbols <= 2 * n_words",
    "duplicate_lines": "10 * n_dup_lines <= 5 * size(_lines)",
    "word_length": "word_chars BETWEEN 2 * n_words AND 16 * n_words",
    "capitals": "3 * (length(_text) - length(regexp_replace(_text, '[A-Z]', ''))) <= word_chars",
    "marks": "4 * (length(_text) - length(replace(replace(_text, '!', ''), '?', ''))) <= n_words",
    "distinct_words": "n_words < 40 OR 12 * size(array_distinct(_hashes)) >= n_words",
    "next_word": "5 * size(filter(_hashes, (h, i) -> i > 0 AND h = _hashes[i - 1])) <= n_words",
    "letters": "2 * length(regexp_replace(_text, '[^\\\\p{L}]', '')) >= word_chars",
}


def sampled(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The counts of about ``sample`` rows from all over the table that pass the base rules, in one partition and cut."""
    share = min(1.0, sample / max(1, docs.count()))
    # cut before the filter: pushed below the projections it would repeat their expressions inside lambdas
    return cut(with_counts(docs.select(F.col(text).alias("text")).sample(share, seed=17).repartition(1))).where("NOT base_failed")


def costs(some: DataFrame, rules: dict[str, str], copies: int = COPIES, runs: int = RUNS) -> dict[str, float]:
    """Seconds that each rule takes for a row of ``sampled``; the time of the job itself is taken off."""
    many = some.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = max(1, some.count() * copies)

    def took(rule: str) -> float:
        # the copy's number has a part in it, so each copy is evaluated
        query = many.agg(F.sum(F.expr(f"CAST(NOT ({rule}) AS int) + copy")).alias("n"), *(F.max(F.size(c)) for c in ("_words", "_lines", "_hashes")), F.max(F.length("_text")))
        query.first()  # compiles it
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            query.first()
            times.append(time.perf_counter() - began)
        return sorted(times)[runs // 2]

    nothing = took("true")
    return {name: max(took(rule) - nothing, 0.001) / rows for name, rule in rules.items()}


def rejections(some: DataFrame, rules: dict[str, str]) -> dict[tuple[bool, ...], int]:
    """How many rows of ``sampled`` have each combination of the rules' rejections, in the rules' order."""
    flags = [F.expr(f"NOT ({rule})").alias(f"r{i}") for i, rule in enumerate(rules.values())]
    names = [f"r{i}" for i in range(len(rules))]
    return {tuple(bool(r[n]) for n in names): r["count"] for r in some.select(*flags).groupBy(*names).count().collect()}  # at most a row of the sample


def plan(costs: dict[str, float], rejected: dict[tuple[bool, ...], int]) -> list[tuple[str, float, float]]:
    """The cascade's order: name, cost, and share rejected of the rows that get so far."""
    names, out = list(costs), []
    left, rows = list(costs), dict(rejected)
    while left:
        total = sum(rows.values())
        share = {n: sum(k for flags, k in rows.items() if flags[names.index(n)]) / max(1, total) for n in left}
        best = min(left, key=lambda n: (-share[n] / costs[n], costs[n]))
        out.append((best, costs[best], share[best]))
        left.remove(best)
        rows = {flags: k for flags, k in rows.items() if not flags[names.index(best)]}
    return out


def order(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per cost (cost, share rejected), the most first, of those that reject nothing the cheaper."""
    return sorted(measured, key=lambda k: (-measured[k][1] / max(measured[k][0], 1e-9), measured[k][0]))


def ordered(docs: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> list[tuple[str, float, float]]:
    """``plan`` of the rules, from a sample of ``docs``."""
    rules, some = rules or RULES, sampled(docs, text)
    return plan(costs(some, rules), rejections(some, rules))


def cascade(names: list[str], rules: dict[str, str] | None = None) -> Column:
    """Whether all rules accept, tried in this order."""
    verdict = "true"
    for name in reversed(names):
        verdict = f"CASE WHEN NOT ({(rules or RULES)[name]}) THEN false ELSE {verdict} END"
    return F.expr(verdict)


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the base counts, base_failed and kept."""
    names = [name for name, _, _ in ordered(docs, text)]
    counted = with_counts(docs.select(*keep, F.col(text).alias("text to judge")), "text to judge")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(names))
    return counted.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))

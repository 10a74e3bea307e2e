"""Spans of text by patterns, with DataFrame functions only.

Positions are code points, ends exclusive.  A text's matches are set between marks by one
``regexp_replace`` and counted off the pieces between the marks; the mark is a control character that
no pattern here matches, and one that the text holds itself is replaced by another first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, STAND_IN = "\x01", "\x02"
#: Elements of a block of an array, characters of a block of a text, and a number beyond every position.
BLOCK, CHARS, LAST = 256, 2048, 2147483647


def clean(text: Column) -> Column:
    """The text (null: empty) without marks, position for position."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(STAND_IN))


def pieces(text: Column, pattern: str) -> Column:
    """Parts of a clean text; every second one is a match (leftmost, not overlapping)."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)


def bound(name: str, value: str, then: str) -> str:
    """SQL: ``then``, in which ``name`` stands for a value that is made once, even where a filter carries the whole below other projections."""
    return f"transform(array({value}), {name} -> {then})[0]"


def running(values: str, join: Callable[[str, str], str]) -> str:
    """SQL: for each of an array of ints, what ``join`` makes of all before it, from 0 on; by blocks, so that no array grows one by one beyond ``BLOCK``."""
    part = f"slice(v, i * {BLOCK} + 1, {BLOCK})"  # of the values, made once
    step = f"(a, x) -> named_struct('at', {join('a.at', 'x')}, 'out', concat(a.out, array(a.at))), a -> a.out"
    totals = f"transform(sequence(0, CAST((size(v) - 1) div {BLOCK} AS int)), i -> aggregate({part}, 0, (a, x) -> {join('a', 'x')}))"
    nothing = "CAST(array() AS array<int>)"
    offsets = f"aggregate({totals}, named_struct('at', 0, 'out', {nothing}), {step})"
    return bound("v", values, f"flatten(transform({offsets}, (o, i) -> aggregate({part}, named_struct('at', o, 'out', {nothing}), {step})))")


def total(a: str, x: str) -> str:
    return f"{a} + {x}"


def most(a: str, x: str) -> str:
    return f"greatest({a}, {x})"


def located(parts: str) -> str:
    """SQL: the matches among ``pieces`` as structs of start, end and hit."""
    none = "CAST(array() AS array<struct<start: int, end: int, hit: string>>)"
    starts = running("transform(ps, p -> length(p))", total)
    return bound(
        "ps",
        parts,
        f"""CASE WHEN size(ps) < 2 THEN {none} ELSE filter(zip_with(ps, {starts},
          (p, at) -> named_struct('start', at, 'end', at + length(p), 'hit', p)), (p, i) -> i % 2 = 1) END""",
    )


def apart(spans: str, taken: str) -> str:
    """SQL: those of the spans (start, end and more) that meet none of ``taken``, by start; both are sorted together, so no pair is tried."""
    every = """array_sort(concat(transform(taken, s -> named_struct('start', s.start, 'later', 0, 'end', s.end, 'own', get(given, -1))),
      transform(given, s -> named_struct('start', s.start, 'later', 1, 'end', s.end, 'own', s))))"""
    until = running("transform(every, s -> CASE WHEN s.later = 0 THEN s.end ELSE 0 END)", most)
    following = running(f"transform(reverse(every), s -> CASE WHEN s.later = 0 THEN {LAST} - s.start ELSE 0 END)", most)
    met = f"""filter(zip_with(every, zip_with({until}, reverse({following}), (u, f) -> named_struct('until', u, 'next', {LAST} - f)),
      (s, x) -> named_struct('keep', s.later = 1 AND x.until <= s.start AND x.next >= s.end, 'own', s.own)), s -> s.keep)"""
    kept = f"CASE WHEN size(given) = 0 OR size(taken) = 0 THEN given ELSE {bound('every', every, f'transform({met}, s -> s.own)')} END"
    return bound("given", spans, bound("taken", taken, kept))


def blocks_of(text: str) -> str:
    """SQL: the text cut into blocks of ``CHARS`` characters."""
    return f"regexp_extract_all({text}, '(?s).{{1,{CHARS}}}', 0)"


def between(start: str, end: str) -> str:
    """SQL: the characters from ``start`` to ``end`` of a text whose ``blocks`` are bound."""
    start, end = f"({start})", f"({end})"
    first = f"greatest({start} - b * {CHARS}, 0)"
    return f"array_join(transform(sequence(CAST({start} div {CHARS} AS int), CAST({end} div {CHARS} AS int)), b -> CASE WHEN b < size(blocks) THEN substring(blocks[b], {first} + 1, greatest(least({end} - b * {CHARS}, {CHARS}) - {first}, 0)) ELSE '' END), '')"


def masked(text: str, spans: str, by: str) -> str:
    """SQL: the text with each of the spans (start, end; in order, may overlap) replaced by ``by``; characters are sought in blocks of the text."""
    until = running("transform(given, s -> s.end)", most)

    before = f"zip_with(given, {until}, (s, at) -> CASE WHEN s.start >= at AND s.end > at THEN concat({between('at', 's.start')}, '{by}') ELSE '' END)"
    tail = bound("at", "array_max(transform(given, s -> s.end))", bound("whole", f"length({text})", f"array({between('at', 'whole')})"))
    return bound("given", spans, f"CASE WHEN size(given) = 0 THEN {text} ELSE {bound('blocks', blocks_of(text), f"array_join(concat({before}, {tail}), '')")} END")


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def upper_tail(z: str) -> str:
    """SQL: the chance that a standard normal value exceeds ``z``; by a continued fraction in the tail, by a rational approximation before."""
    near = f"0.5D * (1 - sqrt(1 - exp(-({z}) * ({z}) * (1.27323954D + 0.07002715D * ({z}) * ({z})) / (2 + 0.14001270D * ({z}) * ({z})))))"
    far = f"0.3989422804D * exp(-0.5D * ({z}) * ({z})) / (({z}) + 1 / (({z}) + 2 / (({z}) + 3 / (({z}) + 4 / (({z}) + 5)))))"
    return f"(CASE WHEN {z} > 2 THEN {far} WHEN {z} >= 0 THEN {near} ELSE 1 - ({near}) END)"

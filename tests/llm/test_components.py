"""Components of links: rounds end as soon as nothing is left to do, and read their links in few tasks."""

from __future__ import annotations

import random

import pytest

from provenant.llm import simhash

_r = random.Random(3)
LINKS = {
    "star at the greatest": [(500, i) for i in range(40)],
    "random": [(_r.randrange(200), _r.randrange(200)) for _ in range(170)],
    "negative": [(-_r.randrange(50), _r.randrange(50)) for _ in range(30)],
    "loops": [(1, 1), (2, 2)],
}


def roots(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


@pytest.mark.parametrize("rows", [1, 500_000])
@pytest.mark.parametrize("name", LINKS)
def test_components_equal_brute_force(spark, name, rows, monkeypatch):
    monkeypatch.setattr(simhash, "ROUND_ROWS", rows)
    got = [(x.node, x.root) for x in simhash.components(spark.createDataFrame(LINKS[name], "a long, b long")).collect()]
    assert len(dict(got)) == len(got) and dict(got) == roots(LINKS[name])


def test_stars_take_no_round(spark, monkeypatch):
    cut, calls = simhash.cut, []
    monkeypatch.setattr(simhash, "cut", lambda df: calls.append(df) or cut(df))
    stars = [(c, 100 * c + i) for c in range(1, 5) for i in range(1, 9)]
    assert {x.node: x.root for x in simhash.components(spark.createDataFrame(stars, "a long, b long")).collect()} == roots(stars)
    assert len(calls) == 1

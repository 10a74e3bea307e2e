"""Importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from provenant.llm import queries, resample

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_r = random.Random(5)
_SOME = ["Alpha", "beta", "gamma9", "über", "漢字", "x", "y", "zeta", "O'Neil", "a_b", "ÄRGER"]


def words(text):
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=2, buckets=10_000, least=20, percent=25, seed=7):
    """(id, n_features, weight, score, rank) of every document."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    of = [[bucket(f) for f in features(t, n)] for _, t in docs]
    s, t = Counter(b for x in of for b in x), Counter(bucket(f) for _, x in target for f in features(x, n))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in s}
    rows = []
    for (i, text), mine in zip(docs, of, strict=True):
        weight = sum(gain[b] for b in mine) // len(mine) if mine else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, (r[:5] for r in rows)))


def test_scan_is_the_crc_of_every_run():
    for n in (1, 2, 3, 5):
        for text in ("", " ", "one", "A b", "Über x1 漢字 end." * 30):
            count, found = resample.scan(text.encode(), n, 1 << 32)
            assert count == len(words(text)) and sorted(found) == sorted(zlib.crc32(f.encode()) for f in features(text, n))


def test_gains_are_floored_and_smoothed():
    got = resample.gains(np.array([0, 3, 7]), np.array([5, 0, 7]))
    assert got.tolist() == [math.floor(1000 * math.log((t + 1) * 13 / ((s + 1) * 15))) for s, t in ((0, 5), (3, 0), (7, 7))]


@pytest.fixture(scope="module")
def tables():
    docs = [(i, " ".join(_r.choice(_SOME) + _r.choice(["", ".", " -", "\n"]) for _ in range(_r.randint(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "..."), (None, "no id " * 15), (5, docs[5][1]), (5, docs[5][1]), (6, docs[7][1]), (303, "Word " * 20), (304, "word " * 19), (305, "long text here " * 30_000)]
    return docs, [(1, "alpha beta gamma9 über"), (2, None), (3, "alpha alpha alpha x y"), (3, "zeta")]


@pytest.mark.parametrize("given", [{}, {"n": 3, "buckets": 97, "least": 5, "percent": 60, "seed": 1}, {"n": 1, "buckets": 70_000}])
def test_resample_matches_brute_force(spark, tables, given):
    docs, target = tables
    asked = {"least_words" if k == "least" else k: v for k, v in given.items()}
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS found", "2 AS weight").repartition(3), spark.createDataFrame(target, "item_id long, text string"), **asked)
    assert sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in got.collect()) == brute(docs, target, **given)


def test_pieces_change_nothing(spark, tables, monkeypatch):
    docs, target = tables
    monkeypatch.setattr(resample, "CHUNK", 100)
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "item_id long, text string"))
    assert sorted(str(list(r)) for r in got.collect()) == brute(docs, target)


def test_empty_tables(spark, tables):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(tables[1], "item_id long, text string")
    assert resample.resample(docs, target).count() == 0
    few = spark.createDataFrame(tables[0][:30], "doc_id long, text string")
    assert sorted(str(list(r)) for r in resample.resample(few, target.where("false")).collect()) == brute(tables[0][:30], [])


def test_registered_query(spark, tmp_path, tables):
    docs, target = tables
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(target, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op12_resample(spark, str(tmp_path))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(str(list(r)) for r in got.collect()) == brute(docs, target)

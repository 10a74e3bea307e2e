"""Substring search by trigrams against a scan of all texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from provenant.functions.text import like_any
from provenant.operators import retrieval, trigrams

_r = random.Random(8)
TEXTS = [None, "", "ab", "abc", "ABCabc", "保修期五年", "保修", "a%c_", "naïve İ", "x😀y😀z", "c" * 500] + ["".join(_r.choice("abAB c保修") for _ in range(_r.randint(0, 60))) for _ in range(150)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("v" if i % 3 else "w", i, t) for i, t in enumerate(TEXTS)], "version_id string, chunk_id long, text_raw string").withColumn("gram", F.lit("clash")).cache()


def test_grams_of_code_points(spark):
    rows = [("abcd",), ("AB",), (None,), ("😀😀😀x",), ("aaaa",), ("保修期",)]
    got = spark.createDataFrame(rows, "t string").select(trigrams.grams("t").alias("g")).collect()
    assert [r.g for r in got] == [["abc", "bcd"], [], [], ["😀😀😀", "😀😀x"], ["aaa"], ["保修期"]]


@pytest.mark.parametrize("keywords", [["abc"], ["B C"], ["保修"], ["a", "abab"], ["保修期", "zzz"], ["%c_"], ["İ"], ["ï"], ["zzz"], [], ["", "q"], ["ABC", "abc"]])
def test_equals_ilike(chunks, keywords):
    want = sorted(r.chunk_id for r in chunks.where(like_any("text_raw", keywords)).collect())
    assert sorted(r.chunk_id for r in trigrams.ilike_any(trigrams.index(chunks), chunks, keywords).collect()) == want


@pytest.mark.parametrize("keys", [trigrams.BROADCAST_KEYS, 0])
def test_equals_the_search_over_texts(spark, chunks, keys, monkeypatch):
    monkeypatch.setattr(trigrams, "BROADCAST_KEYS", keys)
    rows = [(1, "v", ["abc", "Ab", "保修"]), (2, "w", ["bab", "bab", "c"]), (3, "v", []), (4, "v", ["no such thing"]), (5, "u", ["abc"])]
    queries = spark.createDataFrame(rows, "query_id long, version_id string, keywords array<string>")
    key = lambda df: sorted((r.query_id, r.chunk_id, r.score, r.rank0) for r in df.collect())
    want = key(retrieval.substring_search(chunks, queries, 10))
    assert key(trigrams.substring_search(trigrams.index(chunks), chunks, queries, 10)) == want and want


def test_empty_tables(chunks):
    none = chunks.where("false")
    assert trigrams.index(none).count() == 0 and trigrams.ilike_any(trigrams.index(none), none, ["abc", "a"]).count() == 0

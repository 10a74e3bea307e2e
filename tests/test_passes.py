"""Texts are looked through once for all dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import scoring
from provenant.plans import queries as own


def test_dimensions_share_one_pass_over_the_texts(spark):
    said = ("整机质保3年，付款", "设备交付：2小时内到场", "操作培训 6 天", "预付 30%", "保证符合", "none", None)
    texts = F.element_at(F.array(*map(F.lit, said)), (F.col("id") % len(said) + 1).cast("int"))
    chunks = spark.range(60).select(F.when(F.col("id") == 59, "x").when(F.col("id") % 2 == 0, "v").otherwise("w").alias("version_id"), F.col("id").cast("int").alias("chunk_index"), texts.alias("text_raw"))
    more = {"technical": ["NONE"], "training": []}
    done = scoring.analyze(chunks, cap=3, overrides=more)
    assert "Range" not in done._jdf.queryExecution().analyzed().toString()  # what was cut is read, not the texts
    key = lambda df: sorted(map(str, df.collect()))
    assert key(done) == sorted(x for d in scoring.DIMENSIONS for x in key(scoring.score_dimension(chunks, d, 3, more)))


def test_streamed_texts_become_digests_before_the_join(spark):
    plan = own.QUERIES["stream_upsert"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Join") < plan.find("sha2")

"""The result contract where texts are null, on a copy of the driver's smallest tables against their SQL."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables are not here")
def test_null_texts_stay_null(spark, tmp_path):
    for p in TABLES.glob("*.parquet"):
        if p.stem != "documents":
            shutil.copy(p, tmp_path / p.name)
    docs = spark.read.parquet(str(TABLES / "documents.parquet"))
    docs.withColumn("text", F.when(F.col("doc_id") % 3 != 1, F.col("text"))).toPandas().to_parquet(tmp_path / "documents.parquet")
    got = entry.queries()["formatted_results"](spark, str(tmp_path))
    assert got.where("text IS NULL").count() > 0
    assert compare(spark, str(tmp_path), "formatted_results", entry) == ""

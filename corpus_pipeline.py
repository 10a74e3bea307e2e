"""Documents to training data: five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``.  The stages use learned scores, components over the corpus
and a tokeniser, so there is no SQL of the whole (``ORACLE_SQL`` is None); the tests hold the classifier against its
held-out labels and the other stages and the whole against brute force.

Defined cases, for all stages: a null text counts as empty (and is empty after the last); texts of any length are worked on whole;
repeated rows are copies, of which one stays; of documents that are alike the one with the least id stays, null ids
come last; extra columns, of whatever names, pass to the next stage; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import bpe, neardup, quality, secrets, winnow
from provenant.llm.common import remove, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those that are alike: five-word shingles of Jaccard similarity 0.8 or more, directly or through others."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (binary: little-endian unsigned 32-bit), their number, and the text that they decode to."""
    keep = tuple(c for c in docs.columns if c != "text")
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)
    return done.select(*keep, F.decode("decoded", "UTF-8").alias("text"), "n_tokens", "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others return is written to the shared folder."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(at), at
    return STAGES[-1][1](spark, docs, sf_dir)

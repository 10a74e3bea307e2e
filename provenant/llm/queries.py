"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, huffman, langid, pii, quality, resample, rules, secrets, shard, simhash, winnow, wordbpe
from .common import scratch, table
from .spans import listed


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (F.expr(f"CAST(size(filter(base_spans, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in secrets.KINDS[:3])
    return found.select("doc_id", *counts, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (F.expr(f"CAST(size(filter(base_spans, s -> s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 16 shards of near equal bytes."""
    return shard.shard(table(spark, sf_dir, "documents"), 16)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages."""
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return rules.judge(table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of the benchmark, and the items hit."""
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and their decoding, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, read back from files of Huffman-coded blocks."""
    import public_tokenizers

    path = scratch(spark, "huffman")
    huffman.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return huffman.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_wordbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents under a vocabulary with word ends and their decoding, as digests."""
    import public_tokenizers

    done = wordbpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of all documents towards the benchmark's distribution of features."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (op1_simhash, op2_secrets, op3_pii, op4_shards, op5_language, op6_rules, op7_winnowing, op8_quality, op9_bpe, op10_huffman, op11_wordbpe, op12_resample)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return {}

"""Keyed mutations as pure transformations, and the write that applies them.

Parquet tables have no MERGE; each mutation gives the table as it is to be, and ``replace`` writes it beside the old one
and swaps the folders, never over the files that are being read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut


def _same(left: DataFrame, right: DataFrame, key: list[str]) -> Column:
    """Equal keys, null ones among them."""
    return reduce(Column.__and__, (left[k].eqNullSafe(right[f"key {k}"]) for k in key))


def _named(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"key {k}" for k in key})


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old`` join it; of several with one key one joins.  Null keys are equal."""
    there = _named(old.select(*key), key)
    return old.unionByName(new.join(there, _same(new, there, key), "left_anti").dropDuplicates(key).select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str], coalesce: bool = False) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; ``coalesce`` keeps old values where the new are null.  ``new`` has each key once; null keys are equal."""
    values = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*values).alias("o"), F.lit(True).alias("in_old"))
    n = _named(new.select(*key, F.struct(*values).alias("n"), F.lit(True).alias("in_new")), key)
    both = o.join(n, _same(o, n, key), "full_outer")
    pick = (lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))) if coalesce else (lambda c: F.when(F.col("in_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))
    return both.select(*[F.coalesce(F.col(c), F.col(f"key {c}")).alias(c) if c in key else pick(c).alias(c) for c in old.columns])


def touched(old: DataFrame, new: DataFrame, key: list[str], at: Column) -> DataFrame:
    """``upsert`` that keeps the column updated_at: ``at`` on rows that change or come, as it was on others."""
    values = [c for c in old.columns if c not in (*key, "updated_at")]
    before = _named(old.select(*key, F.struct(*values).alias("before"), F.col("updated_at").alias("since")), key)
    met = new.join(before, _same(new, before, key), "left")
    same = F.col("before").isNotNull() & F.col("before").eqNullSafe(F.struct(*(F.col(c) for c in values)))
    return upsert(old, met.withColumn("updated_at", F.when(same, F.col("since")).otherwise(at)).select(*old.columns), key)


def register(old: DataFrame, new: DataFrame, key: list[str], stay: list[str]) -> DataFrame:
    """``upsert`` into a registry: rows that are there keep their columns ``stay`` (an id, a time of entry), all others follow ``new``."""
    before = _named(old.select(*key, *(F.col(c).alias(f"old {c}") for c in stay), F.lit(True).alias("there")), key)
    met = new.join(before, _same(new, before, key), "left")
    kept = met.select(*(F.when(F.col("there"), F.col(f"old {c}")).otherwise(F.col(c)).alias(c) if c in stay else F.col(c) for c in old.columns))
    return upsert(old, kept, key)


def upsert_tree(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree table with ``new`` nodes upserted by node_id, and counts (version_id, level, written, failed) of them.

    A version's nodes come whole or not at all, as in one transaction that writes parents first: every parent is among the old nodes or among the version's
    new ones of a higher level, levels are 0 to 3, and no content is null.  One node that breaks this fails its version, whose old nodes stay; others go on.
    ``new`` has each node_id once.
    """
    above = new.select("version_id", F.col("node_id").alias("parent_id"), F.col("level").alias("above"))
    there = old.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    met = new.select("version_id", "parent_id", "level", "content").join(above, ["version_id", "parent_id"], "left").join(there, "parent_id", "left")
    parent = F.col("parent_id").isNull() | F.col("there").isNotNull() | F.coalesce(F.col("above") > F.col("level"), F.lit(False))
    sound = parent & F.coalesce(F.col("level").between(0, 3), F.lit(False)) & F.col("content").isNotNull()
    broken = _named(met.where(~sound).select("version_id").distinct(), ["version_id"]).withColumn("broken", F.lit(True))
    judged = new.join(broken, _same(new, broken, ["version_id"]), "left")
    counts = judged.groupBy("version_id", "level").agg(F.count_if(F.col("broken").isNull()).alias("written"), F.count_if(F.col("broken")).alias("failed"))
    return upsert(old, judged.where("broken IS NULL").select(*old.columns), ["node_id"]), counts


def write_tree(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """``upsert_tree`` into the table at ``path`` (made if it is not there), put in place by one swap; the counts."""
    recover(spark, path)
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = here.getFileSystem(spark._jsc.hadoopConfiguration()).exists(here)
    table, counts = upsert_tree(spark.read.parquet(path) if held else new.limit(0), new)
    told = cut(counts)  # before the table changes
    replace(spark, table, path)
    return told


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """Delete, then insert: the scopes that ``new`` has hold its rows (one for each key) and nothing else; other scopes stay."""
    return delete_matching(old, new.select(*scope).distinct(), scope).unionByName(new.dropDuplicates([*scope, *key]).select(*old.columns))


def reset_scope(old: DataFrame, scope: DataFrame, key: list[str], confirm: bool) -> tuple[DataFrame, int]:
    """The table without the scope's rows, and how many these are; without ``confirm`` only the count."""
    n = old.join(scope.select(*key).distinct(), key, "left_semi").count()
    return (delete_matching(old, scope, key) if confirm else old), n


def distinct_citations(citations: DataFrame, order: str, by: tuple[str, ...] = ("chunk_id", "page_idx", "bbox")) -> DataFrame:
    """One citation for each chunk, page and box: the first by ``order``."""
    others = [c for c in citations.columns if c not in by]
    return citations.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("x")).select(*by, "x.*")


def delete_matching(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``gone``."""
    return old.join(gone.select(*key), key, "left_anti")


def delete_stale(old: DataFrame, seen: DataFrame, scope: list[str], key: list[str]) -> DataFrame:
    """Within the scopes that ``seen`` has, only rows that it has stay; other scopes stay whole."""
    current = old.join(seen.select(*scope, *key).distinct(), [*scope, *key], "left_semi")
    return current.unionByName(old.join(seen.select(*scope).distinct(), scope, "left_anti"))


def delete_version(tables: dict[str, DataFrame], version_id: str) -> dict[str, DataFrame]:
    """All tables without a version: rows that carry it go, and citations that are left forget its chunks."""
    gone = tables["chunks"].where(F.col("version_id") == version_id).select("chunk_id")
    out = {}
    for name, df in tables.items():
        if "version_id" in df.columns:
            df = df.where(F.col("version_id") != version_id)
        if name == "citations":
            marked = df.join(gone.withColumn("gone", F.lit(True)), "chunk_id", "left")
            df = marked.withColumn("chunk_id", F.when(F.col("gone"), F.lit(None)).otherwise(F.col("chunk_id"))).select(*df.columns)
        out[name] = df
    return out


def embedding_status(chunks: DataFrame) -> DataFrame:
    """pending, completed or failed, from the embedding and the last error."""
    failed = F.col("embedding_error").isNotNull() if "embedding_error" in chunks.columns else F.lit(False)
    return chunks.withColumn("embedding_status", F.when(F.col("embedding").isNotNull(), "completed").when(failed, "failed").otherwise("pending"))


def attach_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors joined to chunks by id; a chunk without a new vector keeps its own."""
    new = vectors.select("chunk_id", F.col("embedding").alias("new_embedding"))
    return chunks.join(new, "chunk_id", "left").withColumn("embedding", F.coalesce("new_embedding", "embedding")).drop("new_embedding")


def recover(spark: SparkSession, path: str) -> None:
    """Finish a ``replace`` that was cut short: if the table is away, the whole new one takes its place, else the old one comes back; remains go."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(conf)
    if not fs.exists(here.getParent()):
        return
    beside = [x.getPath() for x in fs.listStatus(here.getParent())]
    staged = [x for x in beside if x.getName().startswith(f"{here.getName()}.new-") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    aside = [x for x in beside if x.getName().startswith(f"{here.getName()}.old-")]
    if not fs.exists(here) and aside:
        fs.rename((staged or aside)[0], here)
        for x in aside:
            fs.delete(x, True)


def replace(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write the table beside ``path``, then put it in its place; ``recover`` ends what a crash between the two renames left."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(new)
    here, staged, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, new, old))
    fs = here.getFileSystem(conf)
    if fs.exists(here):
        fs.rename(here, aside)
    fs.rename(staged, here)
    fs.delete(aside, True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)

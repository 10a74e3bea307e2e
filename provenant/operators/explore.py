"""Looking around: versions, outlines, pages, contexts, unit evidence, key values, result refinement and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.text import like_any, preview, sha256, unit_hash


def list_versions(versions: DataFrame, documents: DataFrame, projects: DataFrame, chunks: DataFrame, units: DataFrame, project_id: str | None = None, limit: int | None = 100) -> DataFrame:
    """Versions with document, project and counts of chunks, units and pages; of all projects the latest ``limit`` (None: all, in no order), of one all."""
    joined = versions.join(documents, "document_id").join(projects, "project_id")
    stats = chunks.groupBy("version_id").agg(F.count("*").alias("chunk_count"), F.count_distinct("page_idx").alias("page_count"))
    unit_stats = units.groupBy("version_id").agg(F.count("*").alias("unit_count"))
    out = joined.join(stats, "version_id", "left").join(unit_stats, "version_id", "left").fillna(0, ["chunk_count", "page_count", "unit_count"])
    latest = (F.col("created_at").desc_nulls_first(), F.col("version_id"))
    if project_id:
        return out.where(F.col("project_id") == project_id).orderBy(*latest)
    return out if limit is None else out.orderBy(*latest).limit(limit)


def outline(nodes: DataFrame, chunks: DataFrame, max_depth: int = 2, from_root: bool = False) -> DataFrame:
    """Nodes of level up to ``max_depth`` (``from_root``: as many levels from the top), by level and node; versions without nodes show the headings of their chunks."""
    level = F.col("level") >= 3 - max_depth if from_root else F.col("level") <= max_depth
    tree = nodes.where(level).select("version_id", "level", F.col("node_id").alias("id"), F.coalesce("heading", preview("content", 50)).alias("title"), F.col("page_start").alias("page_idx"))
    rest = chunks.where("text_level IS NOT NULL").join(nodes.select("version_id").distinct(), "version_id", "left_anti")
    flat = rest.select("version_id", F.col("text_level").alias("level"), F.col("chunk_id").alias("id"), F.when(F.col("text_level") <= 2, F.col("text_raw")).otherwise(preview("text_raw", 50)).alias("title"), "page_idx")
    return tree.unionByName(flat).orderBy("version_id", "level", "id")


def page_metadata(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: size, chunks by element type, and whether it has tables and images."""
    counts = chunks.groupBy("version_id", "page_idx", "element_type").agg(F.count("*").alias("n"))
    per_page = counts.groupBy("version_id", "page_idx").agg(F.sum("n").alias("chunk_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("element_type", "n")))).alias("element_counts"), F.bool_or(F.col("element_type") == "table").alias("has_tables"), F.bool_or(F.col("element_type") == "image").alias("has_images"))
    return per_page.join(pages, ["version_id", "page_idx"], "left")


def refine(results: DataFrame, min_score: float | None = None, max_score: float | None = None, pages: tuple[int, int] | None = None, types: list[str] | None = None, sort_by: str = "score", ascending: bool = False, dedupe: bool = True) -> DataFrame:
    """Filtered, deduplicated (the first of each chunk by rank; rows without a chunk go) and sorted; a missing score is 0."""
    score = F.coalesce("score", F.lit(0.0))
    tests = [t for t in (score >= min_score if min_score is not None else None, score <= max_score if max_score is not None else None, F.col("page_idx").between(*pages) if pages else None, F.col("element_type").isin(*types) if types else None) if t is not None]
    out = results.where(reduce(Column.__and__, tests)) if tests else results
    if dedupe:
        first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("rank"))
        out = out.where("chunk_id IS NOT NULL").withColumn("nth", first).where("nth = 1").drop("nth")
    keys = [F.coalesce(sort_by, F.lit(0))] + ([score] if sort_by == "page_idx" else [])
    return out.orderBy(*(k.asc() if ascending else k.desc() for k in keys), "chunk_id")


def search_chunks(results: DataFrame, top_k: int, pages: tuple[int, int] | None = None, types: list[str] | None = None) -> DataFrame:
    """Results of a query after its page range and types, the first ``top_k``; the candidates are cut before, as retrieval does."""
    out = results
    if pages:
        out = out.where(F.col("page_idx").between(*pages))
    if types:
        out = out.where(F.col("element_type").isin(*types))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return out.withColumn("nth", again).where(F.col("nth") <= top_k).drop("nth")


def search_by_heading(nodes: DataFrame, keyword: str, children: bool = True, siblings: bool = False) -> DataFrame:
    """Sections and paragraphs whose heading or content has the keyword, with their children or siblings as a list."""
    hits = nodes.where(F.col("node_type").isin("section", "paragraph", "chunk") & (like_any(F.coalesce("heading", F.lit("")), [keyword]) | like_any("content", [keyword])))
    kid = nodes.select(F.col("parent_id").alias("up"), F.struct("level", "node_id", preview("content", 200).alias("content")).alias("kid"))
    if children:
        own = kid.groupBy(F.col("up").alias("node_id")).agg(F.array_sort(F.collect_list("kid")).alias("children"))
        hits = hits.join(own, "node_id", "left")
    if siblings:
        near = kid.groupBy(F.col("up").alias("parent_id")).agg(F.array_sort(F.collect_list("kid")).alias("siblings"))
        hits = hits.join(near, "parent_id", "left").withColumn("siblings", F.filter("siblings", lambda s: s["node_id"] != F.col("node_id")))
    return hits.orderBy("level", "node_id")


def batch_by_chunk(results: DataFrame) -> DataFrame:
    """Each chunk once, as its first query (by ordinal ``q``, then rank) found it, with all queries that did in order."""
    first = F.min_by(F.struct("score", "page_idx"), F.struct("q", "rank"))
    return results.groupBy("chunk_id").agg(first.alias("x"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("q", "query"))), lambda s: s["query"])).alias("matched_queries")).select("chunk_id", "x.score", "x.page_idx", "matched_queries")


def batch_by_page(results: DataFrame) -> DataFrame:
    """Pages (null ones dropped) with their chunks and queries."""
    return results.where("page_idx IS NOT NULL").groupBy("page_idx").agg(F.count("*").alias("results"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("query")).alias("queries"))


def normalize_scores(results: DataFrame) -> DataFrame:
    """Min-max over all results: 0 where all are equal, null where the score is."""
    ends = results.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    both = results.join(F.broadcast(ends))
    return both.withColumn("normalized_score", F.when(F.col("score").isNull(), None).when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)).drop("low", "high")


def neighbours(chunks: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """target_id and its k nearest chunks on the same page by distance of position, then position.

    They are among the k before and the k after it, so a page is sorted and looked at once, never joined with itself.
    """
    w = Window.partitionBy("version_id", "page_idx").orderBy("chunk_index", "chunk_id")
    other = F.struct("chunk_id", "chunk_index")
    around = F.array_compact(F.array(*(f(other, d).over(w) for f in (F.lag, F.lead) for d in range(1, k + 1))))
    at = F.col("chunk_index")
    near = F.transform("around", lambda x: F.struct(F.abs(x["chunk_index"] - at).alias("distance"), x["chunk_index"].alias("chunk_index"), x["chunk_id"].alias("chunk_id")))
    asked = targets.select(F.col("chunk_id").alias("target_id")).distinct()
    seen = chunks.where("page_idx IS NOT NULL AND version_id IS NOT NULL").select("chunk_id", "chunk_index", around.alias("around")).join(asked, F.col("chunk_id") == F.col("target_id"), "left_semi")
    listed = seen.select(F.col("chunk_id").alias("target_id"), F.posexplode(F.slice(F.array_sort(near), 1, k)).alias("nth", "x"))
    return listed.select("target_id", "x.chunk_id", "x.chunk_index", "x.distance", (F.col("nth") + 1).alias("nth"))


def adjacent_pages(chunks: DataFrame, targets: DataFrame, types: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """target_id and the text chunks of the pages before and after."""
    t = targets.select("version_id", F.col("chunk_id").alias("target_id"), F.explode(F.array(F.col("page_idx") - 1, F.col("page_idx") + 1)).alias("page_idx"))
    return chunks.where(F.col("element_type").isin(*types)).join(t, ["version_id", "page_idx"]).select("target_id", "chunk_id", "page_idx", preview("text_raw", 200).alias("preview"))


def hierarchy_of(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id and the nodes whose source chunks have it."""
    listed = nodes.select("node_id", "level", "heading", F.explode("source_chunk_ids").alias("chunk_id"))
    return targets.select("chunk_id").join(listed, "chunk_id").select(F.col("chunk_id").alias("target_id"), "node_id", "level", "heading")


def unit_evidence(units: DataFrame, spans: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Units with their chunks and pages, and whether their hash still holds."""
    again = unit_hash("text_raw", "anchor_json", "source_element_id") == F.col("unit_hash")
    linked = spans.select("unit_id", "chunk_id", "unit_order").join(chunks.select("version_id", "chunk_id", "page_idx", "source_id"), "chunk_id").join(pages.select("version_id", "page_idx", "coord_sys"), ["version_id", "page_idx"], "left")
    per_unit = linked.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "chunk_id", "page_idx", F.coalesce("coord_sys", F.lit("mineru_bbox_v1")).alias("coord_system")))).alias("chunks"))
    return units.withColumn("hash_valid", again).join(per_unit, "unit_id", "left")


def key_values(chunks: DataFrame, keys: list[str], value: str = r"(\d+(?:\.\d+)?)\s*(年|个月|天|小时|%|万元|元|days?|hours?|years?)?", window: int = 50, fuzzy: bool = True) -> DataFrame:
    """version_id, chunk_id, key, context and value: the first occurrence of each key in each chunk (or, not ``fuzzy``, chunks that equal the key), and the first value within twice the window after it."""
    key = F.explode(F.array(*map(F.lit, keys)))
    each = chunks.select("version_id", "chunk_id", "page_idx", "text_raw", key.alias("key"))
    at = F.instr(F.lower("text_raw"), F.lower("key"))
    each = each.withColumn("at", at if fuzzy else F.when(F.col("text_raw") == F.col("key"), 1).otherwise(0)).where("at > 0")
    after = F.substring(F.col("text_raw"), F.col("at") + F.length("key"), F.lit(2 * window))
    begin = F.greatest(F.lit(1), F.col("at") - window)
    context = F.substring(F.col("text_raw"), begin, F.col("at") + F.length("key") + window - begin)
    found = F.regexp_extract(after, f"(?U){value}", 0)
    return each.select("version_id", "chunk_id", "page_idx", "key", context.alias("context"), F.nullif(F.trim(found), F.lit("")).alias("value"))


def latest(files: DataFrame, by: list[str], at: str = "created_at") -> DataFrame:
    """The latest row of each group."""
    others = [c for c in files.columns if c not in by]
    return files.groupBy(*by).agg(F.max_by(F.struct(*others), at).alias("x")).select(*by, "x.*")


def progress(chunks: DataFrame) -> DataFrame:
    """Per version: chunks, and how many are embedded, pending and empty."""
    return chunks.groupBy("version_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"), F.count_if(F.col("embedding").isNull() & (F.coalesce("text_raw", F.lit("")) != "")).alias("pending"), F.count_if(F.coalesce("text_raw", F.lit("")) == "").alias("empty")
    )


def pending(chunks: DataFrame) -> DataFrame:
    """Chunks without an embedding or not marked completed; a null status is neither (three-valued)."""
    return chunks.where("embedding IS NULL OR embedding_status <> 'completed'")


def recommended_ef(n: Column) -> Column:
    """The advised breadth of an approximate index for so many chunks."""
    return F.when(n < 10_000, 64).when(n < 100_000, 100).when(n < 1_000_000, 150).otherwise(200)


def cache_key(*parts: Column) -> Column:
    """A digest of a query's parts."""
    return sha256(F.concat_ws("\x1f", *parts))


def level_counts(nodes: DataFrame) -> DataFrame:
    """Per level: nodes, and how many are embedded and not."""
    return nodes.groupBy("level").agg(F.count("*").alias("total"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("missing"))


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids``, each once however often it is listed; Spark broadcasts the list if it is small."""
    return table.join(ids.select(key), key, "left_semi")


def pending_versions(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Versions that have chunks and no tree."""
    return chunks.select("version_id").distinct().join(nodes.select("version_id"), "version_id", "left_anti")


def tree_progress(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: versions with chunks, those with a tree, and those without."""
    have = nodes.select("version_id").distinct().withColumn("done", F.lit(True))
    return chunks.select("version_id").distinct().join(have, "version_id", "left").agg(F.count("*").alias("total"), F.count_if("done").alias("processed"), F.count_if(F.col("done").isNull()).alias("missing"))


def covered_range(nodes: DataFrame) -> DataFrame:
    """node_id with the first and last position of the leaves (level 0) below it, however deep.

    Ranges go up round by round from the nodes whose range grew; a round that changes nothing ends it, so cycles do as well.
    """
    up = nodes.where("parent_id IS NOT NULL").select("node_id", "parent_id")
    grown = nodes.where("level = 0").select("node_id", F.col("start_pos").alias("low"), F.col("end_pos").alias("high"))
    known = grown
    while True:
        new = up.join(grown, "node_id").groupBy(F.col("parent_id").alias("node_id")).agg(F.min("low").alias("new_low"), F.max("high").alias("new_high"))
        met = new.join(known, "node_id", "left").withColumn("wide", F.col("low").isNull() | (F.col("new_low") < F.col("low")) | (F.col("new_high") > F.col("high"))).where("wide")
        grown = cut(met.select("node_id", F.least("low", "new_low").alias("low"), F.greatest("high", "new_high").alias("high")))
        if grown.isEmpty():
            return known
        known = cut(known.join(grown.select("node_id"), "node_id", "left_anti").unionByName(grown))


def files_of(files: DataFrame, version_id: str, kind: str | None = None) -> DataFrame:
    """Registered files of a version, the oldest first."""
    out = files.where(F.col("version_id") == version_id)
    return (out.where(F.col("file_type") == kind) if kind else out).orderBy(F.col("created_at").asc_nulls_last(), "file_path")


def latest_annotated(files: DataFrame) -> DataFrame:
    """The latest annotated file of each version."""
    return latest(files.where("file_type = 'annotated_pdf'"), ["version_id"])


def pending_queue(chunks: DataFrame, limit: int, version_id: str | None = None) -> DataFrame:
    """The first ``limit`` chunks that wait for an embedding, by version and position."""
    out = chunks.where("embedding_status = 'pending'")
    return (out.where(F.col("version_id") == version_id) if version_id else out).orderBy("version_id", "chunk_index", "chunk_id").limit(limit)


def topic_highlights(targets: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` chunks of each version and topic, by rank."""
    nth = F.row_number().over(Window.partitionBy("version_id", "topic").orderBy("rank", "chunk_id"))
    return targets.withColumn("nth", nth).where(F.col("nth") <= most)


def tool_metrics(calls: DataFrame) -> DataFrame:
    """Per tool: calls, errors and mean milliseconds, from a log of calls (tool, ok, ms)."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.avg("ms"), 2).alias("mean_ms"))


def run_summary(runs: DataFrame, citations: DataFrame) -> DataFrame:
    """Runs with their number of citations and of dimensions cited; runs without any have none of both."""
    counts = citations.groupBy("run_id").agg(F.count("*").alias("citations"), F.count_distinct("dimension").alias("dimensions"))
    return runs.join(counts, "run_id", "left").fillna(0, ["citations", "dimensions"])


def merge_distinct(*lists: Column) -> Column:
    """Lists as one without repeats, each member where it came first; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(x, none) for x in lists))))

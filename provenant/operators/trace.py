"""Traceability and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evidence_hash, is_bbox


def citation_code() -> Column:
    """The first check that a citation fails; null if it is traceable."""
    return (
        F.when(F.coalesce("chunk_id", F.lit("")) == "", "citation_missing_chunk_id")
        .when(F.col("page_idx").isNull() | (F.col("page_idx") < 0), "citation_missing_page_idx")
        .when(~is_bbox("bbox"), "citation_missing_bbox")
    )


def traceability(citations: DataFrame, runs: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row a run (run_id): citation counts, coverage to four places, status and sorted warnings.

    ``citations``: run_id, dimension, chunk_id, page_idx, bbox; ``warnings``: run_id and warning codes of earlier steps.
    """
    coded = citations.withColumn("code", citation_code())
    per_dimension = coded.groupBy("run_id", "dimension").agg(
        F.count("*").alias("n"), F.count_if(F.col("code").isNull()).alias("ok"), F.collect_set("code").alias("codes"), F.collect_set(F.when(F.col("code").isNull(), F.col("chunk_id"))).alias("ready")
    )
    total = per_dimension.groupBy("run_id").agg(
        F.count("*").alias("dimension_count"), F.count_if(F.col("ok") > 0).alias("dimension_with_traceable_citations"), F.sum("n").alias("citation_count_total"), F.sum("ok").alias("citation_count_traceable"),
        F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ready")))).alias("highlight_ready_chunk_ids"),
    )
    out = runs.select("run_id").join(total, "run_id", "left").fillna(0, ["dimension_count", "dimension_with_traceable_citations", "citation_count_total", "citation_count_traceable"])
    none = F.array().cast("array<string>")
    out = out.withColumn("codes", F.coalesce("codes", none)).withColumn("highlight_ready_chunk_ids", F.coalesce("highlight_ready_chunk_ids", none))
    if warnings is not None:
        earlier = warnings.groupBy("run_id").agg(F.collect_set("warning").alias("earlier"))
        out = out.join(earlier, "run_id", "left").withColumn("codes", F.concat(F.coalesce("earlier", none), F.col("codes")))
    t, n = F.col("citation_count_traceable"), F.col("citation_count_total")
    own = F.array_compact(F.array(F.when(n == 0, F.lit("no_evidence_citations")), F.when(n > t, F.lit("partial_untraceable_citations")), F.when(F.size("highlight_ready_chunk_ids") == 0, F.lit("no_highlight_ready_chunks"))))
    status = F.when((n == 0) | (t == 0), "unverifiable").when(t == n, "verified").otherwise("verified_with_warnings")
    ratio = F.when(n > 0, F.round(t / n, 4)).otherwise(0.0)
    return out.select(
        "run_id", status.alias("status"), "dimension_count", "dimension_with_traceable_citations", "citation_count_total", "citation_count_traceable", (n - t).alias("citation_count_untraceable"),
        ratio.alias("citation_coverage_ratio"), "highlight_ready_chunk_ids", F.array_sort(F.array_distinct(F.concat("codes", own))).alias("warnings"),
    )


def verify_citations(requested: DataFrame, citations: DataFrame, units: DataFrame) -> DataFrame:
    """For each requested citation_id whether it stands, and the codes of what is wrong.

    A citation stands if its hash is that of its quote, unit and anchor, and its anchor is null or the unit's.
    """
    c = citations.select("citation_id", "unit_id", "quote_text", "evidence_hash", F.col("anchor_json").alias("cited_anchor"))
    u = units.select("unit_id", "unit_hash", "anchor_json")
    both = requested.select("citation_id").join(c.join(u, "unit_id"), "citation_id", "left")
    hashed = evidence_hash("quote_text", "unit_hash", "anchor_json") == F.col("evidence_hash")
    anchored = F.col("cited_anchor").isNull() | F.col("cited_anchor").eqNullSafe(F.col("anchor_json"))
    found = F.col("unit_id").isNotNull()
    codes = F.when(~found, F.array(F.lit("citation_not_found"))).otherwise(
        F.array_compact(F.array(F.when(~F.coalesce(hashed, F.lit(False)), F.lit("hash_mismatch")), F.when(~anchored, F.lit("anchor_mismatch"))))
    )
    return both.select("citation_id", "unit_id", codes.alias("codes")).withColumn("verified", F.size("codes") == 0)


def citation_summary(verified: DataFrame) -> DataFrame:
    """One row: citations, how many stand, and the sorted distinct codes."""
    return verified.agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("warning_codes"))


def highlight_targets(results: DataFrame) -> DataFrame:
    """Per query: ordered distinct chunk ids that can be highlighted, how many results were left out, and sorted codes."""
    codes = F.array_compact(
        F.array(
            F.when(F.coalesce("chunk_id", F.lit("")) == "", F.lit("missing_chunk_id")),
            F.when(F.col("bbox").isNull(), F.lit("missing_chunk_bbox")),
            F.when(~F.coalesce(F.col("evidence_status").isin("verified", "verified_with_warnings"), F.lit(False)), F.lit("unverifiable_evidence_for_highlight")),
        )
    )
    coded = results.withColumn("codes", codes)
    ok = F.size("codes") == 0
    ordered = F.array_sort(F.collect_list(F.when(ok, F.struct("rank", "chunk_id"))))
    return coded.groupBy("query_id").agg(F.array_distinct(F.transform(ordered, lambda x: x["chunk_id"])).alias("chunk_ids"), F.count_if(~ok).alias("excluded_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("warnings"))


#: Colours of topics (red, green, blue of 0..1).
COLORS = {"risk": (1.0, 0.0, 0.0), "benefit": (0.0, 1.0, 0.0), "info": (0.0, 0.0, 1.0), "warranty": (1.0, 0.5, 0.0), "delivery": (0.0, 0.5, 1.0), "training": (0.5, 0.0, 1.0)}


def hex_color(c: Column) -> Column:
    """#rrggbb as three numbers of 0..1."""
    part = lambda i: F.conv(F.substring(F.ltrim(c, F.lit("#")), i, 2), 16, 10).cast("double") / 255
    return F.array(part(1), part(3), part(5))


def annotation_rows(chunks: DataFrame, topic: str, content: Column, opacity: float = 0.3, scale: float = 1000.0) -> DataFrame:
    """One row a box: page, rectangle in page units where the page's size is known (boxes are of 0..1000), colour and content."""
    r, g, b = COLORS.get(topic, (1.0, 1.0, 0.0))
    box = chunks.select("chunk_id", "page_idx", F.explode("rects").alias("r"), "page_w", "page_h", content.alias("content"))
    on = lambda i, size: F.when(F.col(size) > 0, F.col("r")[i] / scale * F.col(size)).otherwise(F.col("r")[i])
    return box.select("chunk_id", "page_idx", F.array(on(0, "page_w"), on(1, "page_h"), on(2, "page_w"), on(3, "page_h")).alias("rect"), F.array(F.lit(r), F.lit(g), F.lit(b)).alias("rgb"), F.lit(opacity).alias("opacity"), "content")


def located(citations: DataFrame) -> DataFrame:
    """Citations with a locator: text by page and box; other kinds of evidence have none."""
    place = F.struct(F.lit("text_bbox").alias("kind"), "page_idx", "bbox")
    return citations.withColumn("locator", F.when(is_bbox("bbox") & F.col("page_idx").isNotNull(), place))

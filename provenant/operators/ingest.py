"""From parsed items to pages, content units, chunks and spans, and back-fills between the layers.

Items are one DataFrame: version_id, pos (position in the parsed list, all items counted), type, page_idx,
bbox (array of boxes), text, text_level, table_body, table_caption, table_footnote, image_caption,
image_footnote, list_items, img_path, source_element_id.  Everything is keyed by version, so all versions go through one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json, preview, stable_id, strip, strip_tags, text_hash, unit_hash

#: Items that make no chunk, and the coordinate system of parsed boxes.
SKIPPED = ("page_number", "header", "footer")
COORDS = "mineru_bbox_v1"

ITEM = (
    "version_id string, pos int, type string, page_idx int, bbox array<array<double>>, text string, text_level int, table_body string, table_caption array<string>, "
    "table_footnote array<string>, image_caption array<string>, image_footnote array<string>, list_items array<string>, img_path string, source_element_id string"
)


@dataclass
class Layers:
    """The tables that one ingest makes."""

    pages: DataFrame
    units: DataFrame
    chunks: DataFrame
    spans: DataFrame
    stats: DataFrame


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", F.filter(F.flatten(F.array(*parts)), lambda x: F.coalesce(x, F.lit("")) != ""))


def _list(name: str) -> Column:
    return F.coalesce(F.transform(F.col(name), strip), F.array().cast("array<string>"))


def item_text() -> Column:
    """The text of an item by its type: tables and images join caption, body and footnote, lists their members."""
    one = lambda c: F.array(F.coalesce(c, F.lit("")))
    kind = F.col("type")
    return (
        F.when(kind == "table", _joined(_list("table_caption"), one(strip_tags("table_body")), _list("table_footnote")))
        .when(kind == "image", _joined(_list("image_caption"), _list("image_footnote")))
        .when(kind == "list", _joined(_list("list_items")))
        .otherwise(F.coalesce(strip("text"), F.lit("")))
    )


def valid_rects(bbox: Column) -> Column:
    """The well-formed boxes of four numbers."""
    return F.coalesce(F.filter(bbox, lambda b: (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull())), F.array().cast("array<array<double>>"))


def page_sizes(items: DataFrame) -> DataFrame:
    """Greatest x2 and y2 of every page over all its items, those without chunks included; never below zero."""
    rects = items.select("version_id", F.coalesce("page_idx", F.lit(0)).alias("page_idx"), F.explode_outer(valid_rects(F.col("bbox"))).alias("r"))
    size = lambda i: F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("r")[i]), F.lit(0.0)))
    return rects.groupBy("version_id", "page_idx").agg(size(2).alias("page_w"), size(3).alias("page_h")).withColumn("coord_sys", F.lit(COORDS))


def anchors(rects: Column, source: Column) -> Column:
    """The anchor of a unit: one entry a box, fields in alphabetical order; null without boxes."""
    each = F.transform(
        rects,
        lambda b: F.struct(
            b.alias("bbox"),
            F.lit(COORDS).alias("coord_sys"),
            F.col("page_h").alias("page_h"),
            F.col("page").alias("page_idx"),
            F.col("page_w").alias("page_w"),
            F.col("img_path").alias("path"),
            F.struct(source.alias("element_id")).alias("source"),
        ),
    )
    return F.when(F.size(rects) > 0, F.struct(each.alias("anchors")))


def ingest(items: DataFrame) -> Layers:
    """Pages, units, chunks, spans and stats of all versions of the items."""
    sizes = page_sizes(items)
    paged = items.withColumn("page", F.coalesce("page_idx", F.lit(0)))
    kept = paged.where(~F.coalesce("type", F.lit("")).isin(*SKIPPED)).withColumn("body", item_text())
    level = F.when((F.col("text_level") == 1) & (F.col("body") == ""), F.lit(None)).otherwise(F.col("text_level"))
    source = F.format_string("chunk_%04d", "pos")
    sized = kept.join(sizes.select("version_id", F.col("page_idx").alias("page"), "page_w", "page_h"), ["version_id", "page"], "left").withColumn("level", level).withColumn("source_id", source)
    rects = valid_rects(F.col("bbox"))
    whole = sized.withColumn("rects", rects).withColumn("anchor", anchors(F.col("rects"), F.coalesce("source_element_id", "source_id"))).withColumn("anchor_json", canonical_json("anchor"))
    whole = whole.withColumn("chunk_id", stable_id("version_id", F.lit("chunk"), "source_id")).withColumn("unit_id", stable_id("version_id", F.lit("unit"), "pos"))
    chunks = whole.select(
        "version_id", "chunk_id", "source_id", F.col("pos").alias("chunk_index"), F.col("page").alias("page_idx"), "rects", F.get("rects", F.lit(0)).alias("bbox"), F.col("type").alias("element_type"),
        F.col("level").alias("text_level"), F.col("body").alias("text_raw"), text_hash("body").alias("text_hash"), F.col("img_path"),
    )
    units = whole.select(
        "version_id", "unit_id", F.col("pos").alias("unit_index"), F.col("type").alias("unit_type"), F.col("body").alias("text_raw"), F.length("body").alias("char_count"), "anchor", "anchor_json",
        F.coalesce("source_element_id", "source_id").alias("source_element_id"), unit_hash("body", "anchor_json", F.coalesce("source_element_id", "source_id")).alias("unit_hash"),
    )
    spans = whole.select("version_id", "chunk_id", "unit_id", F.lit(0).alias("unit_order"), F.lit(0).alias("start_char"), F.length("body").alias("end_char"))
    return Layers(sizes, units, chunks, spans, type_counts(items))


def type_counts(items: DataFrame) -> DataFrame:
    """Items of each version by their type, skipped types among them; a null type counts as empty."""
    return items.groupBy("version_id", F.coalesce("type", F.lit("")).alias("element_type")).agg(F.count("*").alias("n"))


def rebuild(units: DataFrame, group_size: int = 2, prefix: str = "rechunk") -> tuple[DataFrame, DataFrame]:
    """Chunks of every ``group_size`` units in order, and their spans; units stay as they are.

    The chunk keeps every unit's boxes (rects) and their union (bbox), so it stays traceable.
    """
    w = Window.partitionBy("version_id").orderBy("unit_index")
    numbered = units.withColumn("n", F.row_number().over(w) - 1).withColumn("chunk_index", F.floor(F.col("n") / group_size).cast("int")).withColumn("unit_order", (F.col("n") % group_size).cast("int"))
    member = F.struct("unit_order", "unit_id", "text_raw", F.col("anchor.anchors").alias("anchors"))
    grouped = numbered.groupBy("version_id", "chunk_index").agg(F.array_sort(F.collect_list(member)).alias("members"))
    flat = F.flatten(F.filter(F.col("members.anchors"), lambda a: a.isNotNull()))
    grouped = grouped.withColumn("source_id", F.format_string(f"{prefix}_{group_size}_%04d", "chunk_index")).withColumn("anchors", flat)
    grouped = grouped.withColumn("rects", F.transform("anchors", lambda a: a["bbox"])).withColumn("chunk_id", stable_id("version_id", F.lit("chunk"), "source_id"))
    edge = lambda i, f: f(F.transform("rects", lambda r: r[i]))
    text = F.concat_ws("\n", F.filter(F.col("members.text_raw"), lambda t: F.coalesce(t, F.lit("")) != ""))
    chunks = grouped.select(
        "version_id", "chunk_id", "source_id", "chunk_index", F.coalesce(F.get("anchors", F.lit(0))["page_idx"], F.lit(0)).alias("page_idx"), "rects",
        F.when(F.size("rects") > 0, F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))).alias("bbox"), F.lit("rechunk").alias("element_type"), text.alias("text_raw"),
        text_hash(text).alias("text_hash"),
    )
    spans = grouped.select("version_id", "chunk_id", F.explode("members").alias("m")).select(
        "version_id", "chunk_id", "m.unit_id", "m.unit_order", F.lit(0).alias("start_char"), F.length(F.coalesce("m.text_raw", F.lit(""))).alias("end_char")
    )
    return chunks, spans


def backfill(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages, units and spans made from chunks one to one, and how many of each there are by version."""
    rects = F.explode_outer(F.coalesce("rects", F.array().cast("array<array<double>>")))
    boxes = chunks.select("version_id", F.coalesce("page_idx", F.lit(0)).alias("page_idx"), rects.alias("r"))
    top = lambda i: F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("r")[i]), F.lit(0.0)))
    pages = boxes.groupBy("version_id", "page_idx").agg(top(2).alias("page_w"), top(3).alias("page_h")).withColumn("coord_sys", F.lit(COORDS))
    sized = chunks.withColumn("page", F.coalesce("page_idx", F.lit(0))).join(pages.select("version_id", F.col("page_idx").alias("page"), "page_w", "page_h"), ["version_id", "page"], "left")
    whole = sized.withColumn("anchor", anchors(F.coalesce("rects", F.array().cast("array<array<double>>")), F.col("source_id"))).withColumn("anchor_json", canonical_json("anchor")).withColumn("unit_id", stable_id("version_id", F.lit("unit"), "chunk_index"))
    units = whole.select(
        "version_id", "unit_id", F.col("chunk_index").alias("unit_index"), F.col("element_type").alias("unit_type"), "text_raw", F.length("text_raw").alias("char_count"), "anchor", "anchor_json",
        F.col("source_id").alias("source_element_id"), unit_hash("text_raw", "anchor_json", "source_id").alias("unit_hash"),
    )
    spans = whole.select("version_id", "chunk_id", "unit_id", F.lit(0).alias("unit_order"), F.lit(0).alias("start_char"), F.length(F.coalesce("text_raw", F.lit(""))).alias("end_char"))
    counts = whole.groupBy("version_id").agg(F.count("*").alias("units"), F.count_distinct("page").alias("pages"), F.count("*").alias("spans"))
    return pages, units, spans, counts


def previews(chunks: DataFrame, n: int = 200) -> DataFrame:
    """Chunks with their first characters only."""
    return chunks.withColumn("preview", preview("text_raw", n))

"""The document tree: paragraphs, sections, root, walks over it, and the section context of chunks.

Levels: 0 sentence, 1 paragraph, 2 section, 3 document.  Islands are running sums over a version in blocks; walks go as deep
as a tree does, or a known number of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.text import stable_id, strip
from .ingest import item_text
from .order import RANGES, carried, previous, running_count
from .retrieval import vector_search

#: Types that stand alone, and types that make no leaf.
BREAKS = ("table", "image", "header", "footer", "page_number")
#: Positions of a version that one task looks through.
BLOCK = 100_000


def is_heading() -> Column:
    """A text item with a level."""
    return (F.col("type") == "text") & (F.coalesce("text_level", F.lit(0)) > 0)


def paragraphs(items: DataFrame) -> DataFrame:
    """Leaves (page numbers make none) with title (the text of headings) and para, the running number of their paragraph, of the non-blank items of each version.

    A version stands in blocks of ``BLOCK`` positions: the last row before a block and the count of paragraphs before it are carried in.
    """
    named = items.withColumn("body", strip(item_text())).where("body <> ''").withColumn("heading", F.coalesce(is_heading(), F.lit(False))).withColumn("title", F.when(F.col("heading"), F.col("body"))).withColumn("page", F.coalesce("page_idx", F.lit(0)))
    named = named.withColumn("block", F.floor(F.col("pos") / BLOCK))
    rows = previous(named, ["version_id"], "block", "pos", F.struct("type", "heading", "page"), "before")
    before = F.col("before")
    new = before.isNull() | F.col("heading") | before["heading"] | before["type"].isin(*BREAKS) | F.col("type").isin(*BREAKS) | (before["page"] != F.col("page")) | (before["type"] != F.col("type"))
    counted = running_count(rows.withColumn("new", F.coalesce(new, F.lit(True))), ["version_id"], "block", "pos", F.col("new"), "para")
    return counted.drop("before", "new").where("type <> 'page_number'")


def build(items: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """All nodes: version_id, node_id, parent_id, level, node_type, content, heading, page_start, page_end, page_range, start_pos, end_pos, element_types, source_chunk_ids, children_ids, leaf_count.

    A heading opens a section that contains it; what comes before the first is a section without a heading.  Positions and chunk
    ids are carried from the items.  ``titles`` (version_id, title) names the roots.
    """
    leaves = paragraphs(items).withColumn("chunk_id", stable_id("version_id", F.lit("chunk"), F.format_string("chunk_%04d", "pos")))
    leaves = running_count(leaves, ["version_id"], "block", "pos", F.col("heading"), "section")
    leaves = leaves.withColumn("sentence_node", stable_id("version_id", F.lit("sentence"), "pos")).withColumn("para_node", stable_id("version_id", F.lit("paragraph"), "para")).withColumn("section_node", stable_id("version_id", F.lit("section"), "section"))
    leaves = leaves.withColumn("root_node", stable_id("version_id", F.lit("document")))
    none = F.lit(None).cast("string")

    def level(key: str, parent: Column, number: int, kind: str, children: str, text: Column, heading: Column) -> DataFrame:
        # bodies are gathered only where they make the content (a section or root would hold all of its version), and by themselves: who reads no content shuffles no text
        bodies = [F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("bodies")] if number < 2 else []
        part = F.array_sort(F.collect_list(F.struct("pos", F.col(children).alias("child"))))
        grouped = leaves.groupBy("version_id", F.col(key).alias("node_id"), parent.alias("parent_id")).agg(
            part.alias("parts"), *bodies, F.min_by("page", "pos").alias("page_start"), F.min("page").alias("page_low"), F.max("page").alias("page_end"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.array_sort(F.collect_set("type")).alias("element_types"),
            F.min_by("title", "pos").alias("title"), F.count("*").alias("leaf_count"), F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("chunks"),
        )
        return grouped.select(
            "version_id", "node_id", "parent_id", F.lit(number).alias("level"), F.lit(kind).alias("node_type"), text.alias("content"), heading.alias("heading"), "page_start", "page_end",
            F.array("page_low", "page_end").alias("page_range"), "start_pos", "end_pos", "element_types", F.col("chunks.chunk_id").alias("source_chunk_ids"), F.array_distinct(F.col("parts.child")).alias("children_ids"), "leaf_count",
        )

    joined = F.concat_ws(" ", F.col("bodies.body"))
    sentences = level("sentence_node", F.col("para_node"), 0, "sentence", "sentence_node", joined, none).withColumn("children_ids", F.array().cast("array<string>"))
    paras = level("para_node", F.col("section_node"), 1, "paragraph", "sentence_node", joined, none)
    sections = level("section_node", F.col("root_node"), 2, "section", "para_node", F.coalesce(F.col("title"), F.lit("")), F.col("title"))
    roots = level("root_node", none, 3, "document", "section_node", F.lit(""), none)
    out = sentences.unionByName(paras).unionByName(sections).unionByName(roots)
    if titles is not None:
        named = titles.select("version_id", F.col("title").alias("doc_title"))
        out = out.join(named, "version_id", "left").withColumn("content", F.when(F.col("level") == 3, F.coalesce("doc_title", F.lit(""))).otherwise(F.col("content"))).drop("doc_title")
    return out


def stored(nodes: DataFrame) -> DataFrame:
    """Nodes of ``build`` as rows of the tree table: the units that each covers, and the first and last chunk of sentences and paragraphs."""
    ends = F.col("level") <= 1
    return nodes.select(
        "node_id", "version_id", "parent_id", "level", "node_type", "content", "children_ids", "source_chunk_ids",
        F.when(ends, F.get("source_chunk_ids", F.lit(0))).alias("start_chunk_id"), F.when(ends, F.try_element_at("source_chunk_ids", F.lit(-1))).alias("end_chunk_id"),
        F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).alias("covered_unit_range"),
    )


def _walk(edges: DataFrame, now: DataFrame, start: str, step: int, depth: int | None, once: Column | None = None) -> DataFrame:
    """``start``, node_id and depth of what the edges (here, there) reach, ``depth`` steps far.

    Without a depth the walk goes on while a round finds something new: each round's rows are cut into the shared folder, and a node that
    was reached from a start before is not reached again, so a cycle ends it too.  ``once`` holds for steps of a walk that reaches no node twice
    while it holds: what was reached need not be looked up then.  Edges are never broadcast: a table of narrow rows is far larger than its files.
    """
    out = now = now.withColumn("depth", F.lit(0))
    d = 0
    while depth is None or d < depth:
        d += 1
        far = edges.hint("merge") if depth is None else edges
        now = now.join(far, now["node_id"] == far["here"]).select(start, F.col("there").alias("node_id"), F.lit(step * d).alias("depth"))
        if depth is None:
            if once is None:
                now = now.dropDuplicates([start, "node_id"]).join(out.select(start, "node_id").hint("merge"), [start, "node_id"], "left_anti")
            now = cut(now if once is None else now.where(once))
            if now.isEmpty():
                break
        out = out.unionByName(now)
    return out


@contextmanager
def _held(edges: DataFrame) -> Iterator[None]:
    """The edges stay with the executors while a walk goes round.

    What Spark infers from the expressions behind their columns ends there: cut rounds pass such conditions on, and where a parent is worked out from its
    child (or a child from its parent) they would double with every round, in the plans on the driver and in the filters of the tasks.
    """
    own = edges.storageLevel == StorageLevel.NONE
    if own:
        edges.persist()
    try:
        yield
    finally:
        if own:
            edges.unpersist()


def _unique(df: DataFrame, column: str) -> bool:
    return df.groupBy(column).count().where("count > 1").isEmpty()


def _ends(edges: DataFrame) -> bool:
    """Whether all walks along the edges end (no cycle), where one edge at most leaves each node: every round doubles the steps and keeps the nodes that so many can be taken from."""
    far, steps, most = edges, 1, edges.count()
    while steps <= most:
        on = far.select(F.col("here").alias("there"), F.col("there").alias("beyond"))
        far = cut(far.join(on.hint("merge"), "there").select("here", F.col("beyond").alias("there")))
        if far.isEmpty():
            return True
        steps *= 2
    return not most


def descendants(nodes: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """root_id, node_id and depth of all nodes below (and at depth 0, themselves); ``depth``: levels that are known to be enough.

    Without a depth, children that have one parent each are not looked up: only its own root can be reached a second time.
    """
    edges = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("here"), F.col("node_id").alias("there"))
    roots = roots.select(F.col("node_id").alias("root_id"), "node_id")
    if depth is not None:
        return _walk(edges, roots, "root_id", 1, depth)
    roots = cut(roots)
    with _held(edges):
        single = _unique(edges, "there") and _unique(roots, "node_id")
        return _walk(edges, roots, "root_id", 1, None, F.col("node_id") != F.col("root_id") if single else None)


def ancestors(nodes: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """start_id, node_id and depth (0, -1, ...) of all nodes above; ``depth``: levels that are known to be enough.

    Without a depth, it is told first whether the nodes are trees: a walk up then needs no look at what it has reached.
    """
    edges = nodes.where("parent_id IS NOT NULL").select(F.col("node_id").alias("here"), F.col("parent_id").alias("there"))
    starts = starts.select(F.col("node_id").alias("start_id"), "node_id")
    if depth is not None:
        return _walk(edges, starts, "start_id", -1, depth)
    starts = cut(starts)
    with _held(edges):
        trees = _unique(edges, "here") and _unique(starts, "node_id") and _ends(edges)
        return _walk(edges, starts, "start_id", -1, None, F.lit(True) if trees else None)


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, value: str, order: str, ranges: int | None = None) -> DataFrame:
    """Each left row with the value of the last right row of its group at or before it: a union and windows, no range join.

    Each group is one window, or, with ``ranges``, both sides are dealt to so many ranges of group and time, cut into the shared folder, and the
    last value before a range is carried into it: for groups too large for a task.
    """
    a = left.select(by, F.col(left_at).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[order].dataType).alias("ord"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("value"))
    b = right.select(by, F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(order).alias("ord"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(value).alias("value"))
    both, group = a.unionByName(b), [by]
    if ranges:
        both, group = cut(both.repartitionByRange(ranges, by, "at", "side", "ord").withColumn("range", F.spark_partition_id())), [by, "range"]
    last = F.last("value", ignorenulls=True).over(Window.partitionBy(*group).orderBy("at", "side", "ord").rowsBetween(Window.unboundedPreceding, 0))
    if ranges:
        ends = both.where("value IS NOT NULL").groupBy(by, "range").agg(F.max_by("value", F.struct("at", "side", "ord")).alias("end"))
        spans = both.select(by, "range").distinct()
        before = carried(spans, ends, [by, "range"]).withColumn("carry", F.last("end", ignorenulls=True).over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
        both, last = carried(both, before, [by, "range"]), F.coalesce(last, F.col("carry"))
    return both.withColumn("value", last).where("side = 1").select("row.*", F.col("value").alias(f"as_of_{value}"))


def contextual(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks with contextual_text: their text after the title of the nearest section that starts on or before their page."""
    sections = nodes.where("level = 2 AND heading IS NOT NULL").select("version_id", "page_start", "heading", "start_pos")
    pages = chunks.select("version_id", "page_idx").distinct()  # all that the title depends on: no text is dealt to the ranges
    named = carried(chunks, as_of(pages, sections, "version_id", "page_idx", "page_start", "heading", "start_pos", RANGES), ["version_id", "page_idx"])
    title = F.col("as_of_heading")
    return named.withColumn("contextual_text", F.when(title.isNotNull(), F.concat(F.lit("["), title, F.lit("] "), F.col("text_raw"))).otherwise(F.col("text_raw"))).withColumnRenamed("as_of_heading", "section_title")


def capped(nodes: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The nodes of versions that have at most ``most``, and (version_id, nodes) of the others, which a tree job refuses."""
    sizes = nodes.groupBy("version_id").agg(F.count("*").alias("nodes"))
    over = sizes.where(F.col("nodes") > most)
    return nodes.join(over, "version_id", "left_anti"), over


def contextual_search(chunks: DataFrame, queries: DataFrame, top_k: int, min_similarity: float | None = None) -> DataFrame:
    """The nearest chunks of ``contextual`` (their vectors are those of contextual_text), as ``vector_search`` finds them."""
    return vector_search(chunks.where("contextual_text <> ''"), queries, top_k, min_similarity)


def parent_sections(nodes: DataFrame) -> DataFrame:
    """Nodes with the heading of their parent section."""
    up = nodes.where("level = 2").select(F.col("node_id").alias("section_id"), F.col("heading").alias("section_heading"), F.col("content").alias("section_content"))
    return nodes.join(up, nodes.parent_id == up.section_id)

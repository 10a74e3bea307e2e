"""The engine's tools: one function each over a Store of typed tables, with validated arguments and a uniform result.

``Store`` opens the layers that ingest wrote; every tool returns a DataFrame and leaves collecting to the caller.
"""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import explore, retrieval, scoring, trace, tree
from .sources.config import redact

#: Limits of the tools.
LIMITS = {"top_k": 100, "batch_queries": 50, "versions": 20, "key_patterns": 50, "context_window": 1000, "query_chars": 10_000, "cached": 1024}


class InvalidArgument(ValueError):
    """An argument outside its contract."""


def need_text(name: str, value: Any, longest: int = LIMITS["query_chars"]) -> str:
    """A non-blank string of bounded length."""
    if not isinstance(value, str) or not value.strip() or len(value) > longest:
        raise InvalidArgument(f"{name} must be a non-empty text of at most {longest} characters")
    return value.strip()


def need_int(name: str, value: Any, low: int, high: int) -> int:
    """An integer within bounds."""
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise InvalidArgument(f"{name} must be an integer of {low}..{high}")
    return value


def need_list(name: str, value: Any, most: int) -> list[str]:
    """A non-empty list of non-blank strings."""
    if not isinstance(value, (list, tuple)) or not 1 <= len(value) <= most or not all(isinstance(v, str) and v.strip() for v in value):
        raise InvalidArgument(f"{name} must be 1..{most} non-empty texts")
    return list(value)


@dataclass
class Metrics:
    """Calls, errors and time of each tool."""

    calls: dict[str, int] = field(default_factory=dict)
    errors: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    last: dict[str, dict[str, Any]] = field(default_factory=dict)


METRICS = Metrics()


def tool(f: Callable) -> Callable:
    """Counts a tool's calls, errors and planning time, and keeps its last parameters without secrets."""

    @wraps(f)
    def call(*args, **kwargs):
        began = time.perf_counter()
        METRICS.calls[f.__name__] = METRICS.calls.get(f.__name__, 0) + 1
        METRICS.last[f.__name__] = redact({k: v for k, v in kwargs.items() if not isinstance(v, DataFrame)})
        try:
            return f(*args, **kwargs)
        except Exception:
            METRICS.errors[f.__name__] = METRICS.errors.get(f.__name__, 0) + 1
            raise
        finally:
            METRICS.seconds[f.__name__] = METRICS.seconds.get(f.__name__, 0.0) + time.perf_counter() - began

    return call


class Store:
    """The layers below a folder; ``tables`` overrides any of them."""

    def __init__(self, spark: SparkSession, path: str = "", tables: dict[str, DataFrame] | None = None):
        self.spark, self.path, self.tables = spark, path, dict(tables or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("tables", "path", "spark"):
            raise AttributeError(name)
        if name not in self.tables:
            at = f"{self.path}/{name}.parquet" if self.path.endswith("/tables") else f"{self.path}/{name}"
            self.tables[name] = self.spark.read.parquet(at).drop("bucket")  # a matter of storage
        return self.tables[name]


def _query(store: Store, version_ids: list[str], query: str, keywords: list[str] | None, embed: Callable, fields: dict[str, list[str]]) -> DataFrame:
    rows = [(v, v, query, keywords) for v in version_ids]
    q = store.spark.createDataFrame(rows, "query_id string, version_id string, query string, keywords array<string>")
    q = q.withColumn("keywords", F.coalesce("keywords", retrieval.expand_keywords(F.col("query"), fields)))
    return q.withColumn("embedding", embed(F.col("query")))


@tool
def retrieve(store: Store, version_id: str, query: str, top_k: int = 10, mode: str = "hybrid", keywords: list[str] | None = None, any_keyword: bool = True, include_text: bool = True, max_chars: int | None = None, fields: dict[str, list[str]] | None = None, embed: Callable = retrieval.hash_embedding) -> DataFrame:
    """Ranked chunks of a version with their evidence; an empty list of keywords means none, null means those of the query."""
    need_text("query", query), need_int("top_k", top_k, 1, LIMITS["top_k"]), need_text("version_id", version_id)
    q = _query(store, [version_id], query, keywords, embed, fields or {})
    ranked = retrieval.ranked(store.chunks, q, top_k, mode, list(fields) if fields else None, any_keyword)
    return retrieval.formatted(retrieval.with_evidence(ranked, store.chunks, store.pages, store.spans, store.units), include_text, max_chars)


@tool
def search_chunks(store: Store, version_id: str, query: str, top_k: int = 10, mode: str = "hybrid", page_range: tuple[int, int] | None = None, element_types: list[str] | None = None, **options) -> DataFrame:
    """Results within pages and of types, out of twice as many candidates."""
    need_int("top_k", top_k, 1, LIMITS["top_k"])
    q = _query(store, [version_id], need_text("query", query), options.get("keywords"), options.get("embed", retrieval.hash_embedding), options.get("fields") or {})
    ranked = retrieval.ranked(store.chunks, q, 2 * top_k, mode)
    out = retrieval.formatted(retrieval.with_evidence(ranked, store.chunks, store.pages, store.spans, store.units))
    return explore.search_chunks(out, top_k, page_range, element_types)


@tool
def batch_search(store: Store, version_id: str, queries: list[str], top_k: int = 5, mode: str = "hybrid", aggregate_by: str = "query", embed: Callable = retrieval.hash_embedding) -> DataFrame:
    """Results of several queries: all (query, none), by chunk or by page."""
    need_list("queries", queries, LIMITS["batch_queries"]), need_int("top_k", top_k, 1, LIMITS["top_k"])
    rows = [(str(i), version_id, i, t) for i, t in enumerate(queries)]
    q = store.spark.createDataFrame(rows, "query_id string, version_id string, q int, query string").withColumn("keywords", retrieval.tokens("query")).withColumn("embedding", embed(F.col("query")))
    out = retrieval.ranked(store.chunks, q, top_k, mode).join(q.select("query_id", "q", "query"), "query_id").join(store.chunks.select("chunk_id", "page_idx"), "chunk_id").withColumnRenamed("rank0", "rank")
    if aggregate_by == "chunk":
        return explore.batch_by_chunk(out)
    if aggregate_by == "page":
        return explore.batch_by_page(out)
    if aggregate_by in ("query", "none"):
        return out.orderBy("q", "rank")
    raise InvalidArgument("aggregate_by must be query, chunk, page or none")


@tool
def compare_across_versions(store: Store, version_ids: list[str], query: str, top_k: int = 5, normalize: bool = True, mode: str = "hybrid", embed: Callable = retrieval.hash_embedding) -> DataFrame:
    """The query's results in each version in one plan, scores brought to 0..1 over all of them."""
    need_list("version_ids", version_ids, LIMITS["versions"])
    q = _query(store, version_ids, need_text("query", query), None, embed, {}).withColumn("keywords", retrieval.tokens("query"))
    out = retrieval.ranked(store.chunks, q, top_k, mode)
    return explore.normalize_scores(out) if normalize else out


@tool
def extract_key_value(store: Store, version_id: str, key_patterns: list[str], context_window: int = 50, fuzzy: bool = True) -> DataFrame:
    """Keys with their context and the value after them."""
    need_list("key_patterns", key_patterns, LIMITS["key_patterns"]), need_int("context_window", context_window, 0, LIMITS["context_window"])
    return explore.key_values(store.chunks.where(F.col("version_id") == version_id), key_patterns, window=context_window, fuzzy=fuzzy)


@tool
def list_available_versions(store: Store, project_id: str | None = None) -> DataFrame:
    """Versions with counts."""
    return explore.list_versions(store.versions, store.documents, store.projects, store.chunks, store.units, project_id)


@tool
def get_document_outline(store: Store, version_id: str, max_depth: int = 2, from_root: bool = False) -> DataFrame:
    """The outline of a version."""
    need_int("max_depth", max_depth, 0, 10)
    mine = F.col("version_id") == version_id
    return explore.outline(store.nodes.where(mine), store.chunks.where(mine), max_depth, from_root)


@tool
def get_page_metadata(store: Store, version_id: str, pages: list[int] | None = None) -> DataFrame:
    """Sizes and contents of pages: all, or those listed."""
    out = explore.page_metadata(store.chunks.where(F.col("version_id") == version_id), store.pages)
    return out.where(F.col("page_idx").isin(*pages)) if pages else out


@tool
def search_by_heading(store: Store, version_id: str, keyword: str, include_children: bool = True, include_siblings: bool = False) -> DataFrame:
    """Nodes by heading."""
    return explore.search_by_heading(store.nodes.where(F.col("version_id") == version_id), need_text("keyword", keyword), include_children, include_siblings)


@tool
def filter_and_sort_results(results: DataFrame, **options) -> DataFrame:
    """Results filtered, deduplicated and sorted."""
    return explore.refine(results, **options)


@tool
def get_chunk_with_context(store: Store, chunk_id: str, depth: str = "all") -> DataFrame:
    """What stands around a chunk: its hierarchy, chunks of its page and of the pages beside, as (relation, chunk or node id, text)."""
    target = store.chunks.where(F.col("chunk_id") == chunk_id)
    up = explore.hierarchy_of(store.nodes, target).select(F.lit("hierarchy").alias("relation"), F.col("node_id").alias("id"), F.col("heading").alias("text"))
    page = explore.neighbours(store.chunks, target, 5).join(store.chunks.select("chunk_id", "text_raw"), "chunk_id").select(F.lit("page").alias("relation"), F.col("chunk_id").alias("id"), F.substring("text_raw", 1, 200).alias("text"))
    beside = explore.adjacent_pages(store.chunks, target).select(F.lit("adjacent").alias("relation"), F.col("chunk_id").alias("id"), F.col("preview").alias("text"))
    return {"hierarchy": up, "page": page, "adjacent": beside}.get(depth, up.unionByName(page).unionByName(beside))


@tool
def get_unit_evidence(store: Store, unit_id: str) -> DataFrame:
    """A unit, its chunks, and whether its hash holds."""
    return explore.unit_evidence(store.units.where(F.col("unit_id") == unit_id), store.spans, store.chunks, store.pages)


@tool
def prepare_highlight_targets(results: DataFrame) -> DataFrame:
    """Chunks of results that can be highlighted."""
    return trace.highlight_targets(results)


@tool
def highlight_pdf(store: Store, version_id: str, chunk_ids: list[str], topic: str = "risk") -> DataFrame:
    """Annotation rows of chunks; drawing them is the caller's."""
    need_list("chunk_ids", chunk_ids, 100)
    chosen = store.chunks.where((F.col("version_id") == version_id) & F.col("chunk_id").isin(*chunk_ids))
    sized = chosen.join(store.pages.select("version_id", "page_idx", "page_w", "page_h"), ["version_id", "page_idx"], "left")
    return trace.annotation_rows(sized, topic, scoring.annotation(F.col("text_raw"), topic))


@tool
def analyze_bids_comprehensive(store: Store, version_ids: list[str], dimensions: list[str] | None = None, overrides: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Rankings, dimension comparison, recommendations and summary of versions, each a DataFrame."""
    need_list("version_ids", version_ids, LIMITS["versions"])
    known = {d.name: d for d in scoring.DIMENSIONS}
    if unknown := set(dimensions or ()) - set(known):
        raise InvalidArgument(f"unknown dimensions {sorted(unknown)}")
    chosen = tuple(known[d] for d in dimensions) if dimensions else scoring.DIMENSIONS
    chunks = store.chunks.where(F.col("version_id").isin(*version_ids))
    results = scoring.analyze(chunks, chosen, overrides=overrides)
    totals = scoring.overall(results)
    return {"rankings": scoring.rank_bidders(totals), "dimensions": scoring.rank_dimensions(results), "recommendations": scoring.recommendations(results), "summary": scoring.comparison_summary(totals)}


@tool
def build_tree(store: Store, items: DataFrame) -> DataFrame:
    """The document tree of items."""
    return tree.build(items)


class Cache:
    """Results of tools by their arguments, the least lately used going first; a version that changes is forgotten whole."""

    def __init__(self, size: int = LIMITS["cached"]):
        self.size, self.held, self.hits, self.misses = size, OrderedDict(), 0, 0

    def get(self, f: Callable[..., DataFrame], store: Store, version_id: str, **arguments: Any) -> DataFrame:
        """The tool's result, kept by Spark."""
        key = (f.__name__, version_id, json.dumps(arguments, sort_keys=True, default=str))
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
        else:
            self.misses += 1
            self.held[key] = f(store, version_id, **arguments).persist()
            if len(self.held) > self.size:
                self.held.popitem(last=False)[1].unpersist()
        return self.held[key]

    def forget(self, version_id: str | None = None) -> None:
        """Drop a version's results, or all."""
        for key in [k for k in self.held if version_id in (None, k[1])]:
            self.held.pop(key).unpersist()

    def stats(self) -> dict[str, int]:
        """Size, hits and misses."""
        return {"size": len(self.held), "hits": self.hits, "misses": self.misses}


@tool
def resource(store: Store, uri: str) -> DataFrame | dict[str, Any]:
    """What a URI names: unit/ID, chunk/ID, outline/VERSION, limits or health."""
    kind, _, key = need_text("uri", uri).partition("/")
    if kind == "limits":
        return LIMITS
    if kind == "health":
        return health()
    if kind == "unit" and key:
        return explore.unit_evidence(store.units.where(F.col("unit_id") == key), store.spans, store.chunks, store.pages)
    if kind == "chunk" and key:
        mine = store.chunks.where(F.col("chunk_id") == key).join(store.pages.select("version_id", "page_idx", "coord_sys", "page_w", "page_h"), ["version_id", "page_idx"], "left")
        return mine.join(retrieval.evidence_units(store.spans.where(F.col("chunk_id") == key), store.units), "chunk_id", "left")
    if kind == "outline" and key:
        return explore.outline(store.nodes.where(F.col("version_id") == key), store.chunks.where(F.col("version_id") == key))
    raise InvalidArgument(f"unknown resource {uri}")


def health() -> dict[str, Any]:
    """Calls, errors and mean seconds of the tools, and the limits."""
    return {"tools": {k: {"calls": n, "errors": METRICS.errors.get(k, 0), "mean_seconds": METRICS.seconds.get(k, 0.0) / n} for k, n in METRICS.calls.items()}, "limits": LIMITS}

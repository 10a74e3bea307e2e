"""Parsed content as items, judgments and queries, runs, and the outer boundary of PDF parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LISTS = ("table_caption", "table_footnote", "image_caption", "image_footnote", "list_items")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def _list(v: Column, path: str) -> Column:
    """An array of strings, or a string as an array of one; empty members go."""
    part = F.try_variant_get(v, f"$.{path}", "variant")
    many = F.try_variant_get(v, f"$.{path}", "array<string>")
    kind = F.schema_of_variant(part)
    out = F.when(kind.startswith("ARRAY"), many).when(part.isNotNull() & (kind != "VOID"), F.array(_text(v, path))).otherwise(F.array().cast("array<string>"))
    return F.filter(out, lambda x: F.coalesce(x, F.lit("")) != "")


def boxes(v: Column, path: str = "bbox") -> Column:
    """One box, a list of boxes, or either as a JSON string, as an array of boxes; what is malformed is left out."""
    part = F.try_variant_get(v, f"$.{path}", "variant")
    part = F.when(F.schema_of_variant(part) == "STRING", F.try_parse_json(F.try_variant_get(v, f"$.{path}", "string"))).otherwise(part)
    nested = F.schema_of_variant(part).startswith("ARRAY<ARRAY")
    many, one = F.try_variant_get(part, "$", "array<array<double>>"), F.try_variant_get(part, "$", "array<double>")
    none = F.array().cast("array<array<double>>")
    rects = F.when(nested, many).when(one.isNotNull(), F.array(one)).otherwise(none)
    return F.coalesce(F.filter(rects, lambda b: (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull())), none)


def items_of(raw: DataFrame, content: str = "content") -> DataFrame:
    """Items of whole content lists: ``raw`` has version_id and the list as JSON text; positions are those in the list."""
    parsed = raw.select("version_id", F.parse_json(content).alias("doc"))
    parsed.createOrReplaceTempView(view := "provenant_content_lists")
    each = parsed.sparkSession.sql(f"SELECT version_id, item.pos AS pos, item.value AS v FROM {view}, LATERAL variant_explode(doc) AS item")
    v = F.col("v")
    return each.select(
        "version_id", F.col("pos").cast("int").alias("pos"), _text(v, "type").alias("type"), F.try_variant_get(v, "$.page_idx", "int").alias("page_idx"), boxes(v).alias("bbox"), _text(v, "text").alias("text"),
        F.try_variant_get(v, "$.text_level", "int").alias("text_level"), _text(v, "table_body").alias("table_body"), *(_list(v, name).alias(name) for name in _LISTS), _text(v, "img_path").alias("img_path"),
        _text(v, "source_element_id").alias("source_element_id"),
    )


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Content lists of a file or folder, one JSON list a file; the version is the file's path."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    return items_of(raw.select(F.col("_metadata.file_path").alias("version_id"), F.col("value").alias("content")))


def read_output_folders(spark: SparkSession, path: str, name: str = "content_list.json") -> DataFrame:
    """The content list of each output folder below ``path``: of several the one with the shortest path."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{name}").text(path).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("content"))
    root = path.rstrip("/")
    folder = F.regexp_extract(F.element_at(F.split("at", F.lit(_quote(root) + "/")), -1), "^([^/]+)/", 1)
    first = raw.groupBy(folder.alias("version_id")).agg(F.min_by("content", F.struct(F.length("at"), "at")).alias("content"))
    return items_of(first)


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def load(spark: SparkSession, content_list: str | None = None, output_dir: str | None = None, pdf: str | None = None, parse: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """Items and warnings from the first given source: a content list, an output folder, or PDFs through ``parse`` (path, content -> version_id, content)."""
    if content_list:
        return read_content_lists(spark, content_list), ["mineru_bypassed"]
    if output_dir:
        items = read_output_folders(spark, output_dir)
        return items, ["empty_content_list"] if items.isEmpty() else []
    if pdf:
        if parse is None:
            raise ValueError("a PDF needs a parser")
        return items_of(parse(spark.read.format("binaryFile").load(pdf).select("path", "content"))), []
    raise ValueError("no content source is given")


def parse_with(function: Callable[[bytes], str]) -> Callable[[DataFrame], DataFrame]:
    """A ``parse`` for ``load`` from a function of a PDF's bytes to its content list as JSON text."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"version_id": b["path"], "content": [function(bytes(c)) for c in b["content"]]})

    return lambda files: files.mapInPandas(run, "version_id string, content string")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Files of an object store: path, length and time, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries of a JSON list."""
    return spark.read.schema("query_id string, version_tag string, query string, keywords array<string>, query_type string").option("multiLine", True).json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Graded judgments, one JSON object a line."""
    return spark.read.schema("query_id string, version_tag string, source_id string, relevance int, page_idx int").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Scoring runs, one JSON object a file: file, status, warnings, overall_score and its dimensions' scores as a map."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("run_id"), F.parse_json("value").alias("v"))
    get = lambda p, kind: F.try_variant_get("v", p, kind)
    return raw.select("run_id", get("$.status", "string").alias("status"), F.coalesce(get("$.warnings", "array<string>"), F.array().cast("array<string>")).alias("warnings"), get("$.scoring.overall_score", "double").alias("overall_score"), get("$.scoring.risk_level", "string").alias("risk_level"), get("$.traceability.citation_count_total", "int").alias("citations"), get("$.traceability.citation_coverage_ratio", "double").alias("coverage"))


def read_version_map(spark: SparkSession, path: str) -> DataFrame:
    """scenario and version_id of a JSON object that maps the one to the other."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("scenario", "version_id"))

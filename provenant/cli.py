"""Command line: ingest content lists, or run the whole from a source to scores and traceability."""

from __future__ import annotations

import argparse
import json
import sys
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ingest, scoring, trace
from .sources import content
from .sources.config import load_questions
from .streaming.ingest import apply


def build_parser() -> argparse.ArgumentParser:
    """The parser of both commands."""
    p = argparse.ArgumentParser(prog="provenant")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest-content-list", "run-e2e", "run-prod"):
        one = sub.add_parser(name)
        one.add_argument("--content-list")
        one.add_argument("--output-dir")
        one.add_argument("--pdf")
        one.add_argument("--store", required=True, help="folder of the layers")
        one.add_argument("--output", help="file for the JSON result; standard output without")
        if name != "ingest-content-list":
            one.add_argument("--dimensions", nargs="*")
            one.add_argument("--question-pack", default="cn_medical_v1" if name == "run-prod" else None)
            one.add_argument("--question-overlay")
            one.add_argument("--packs-root")
    return p


def score(chunks: DataFrame, dimensions: tuple[scoring.Dimension, ...], overrides: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Scores of all versions, and the traceability of the chunks behind them."""
    results = scoring.analyze(chunks, dimensions, overrides=overrides)
    cited = None
    for d in dimensions:
        one = scoring.candidate_chunks(chunks, d, overrides=overrides).select(F.col("version_id").alias("run_id"), "dimension", "chunk_id", "page_idx", "bbox").distinct()
        cited = one if cited is None else cited.unionByName(one)
    runs = chunks.select(F.col("version_id").alias("run_id")).distinct()
    return {"overall": scoring.overall(results), "dimensions": results, "recommendations": scoring.recommendations(results), "traceability": trace.traceability(cited, runs)}


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, Any]:
    """A command's result."""
    began = time.perf_counter()
    items, warnings = content.load(spark, args.content_list, args.output_dir, args.pdf)
    apply(spark, items, args.store)
    stats = ingest.ingest(items).stats.groupBy("element_type").agg(F.sum("n").alias("n")).collect()  # a row for each type
    out: dict[str, Any] = {"status": "completed", "warnings": warnings, "elements": {r["element_type"]: r["n"] for r in stats}}
    if args.command != "ingest-content-list":
        overrides = None
        if args.question_pack:
            overrides = load_questions(args.question_pack, args.question_overlay, args.packs_root).keywords()
        known = {d.name: d for d in scoring.DIMENSIONS}
        chosen = tuple(known[d] for d in args.dimensions) if args.dimensions else scoring.DIMENSIONS
        parts = score(spark.read.parquet(f"{args.store}/chunks"), chosen, overrides)
        out["scoring"] = [json.loads(r) for r in parts["overall"].toJSON().toLocalIterator()]  # a row for each version
        out["dimensions"] = [json.loads(r) for r in parts["dimensions"].drop("extracted_values").toJSON().toLocalIterator()]
        out["traceability"] = [json.loads(r) for r in parts["traceability"].toJSON().toLocalIterator()]
    out["elapsed_ms"] = round(1000 * (time.perf_counter() - began))
    return out


def main(argv: list[str] | None = None) -> int:
    """Run a command and emit its JSON."""
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    text = json.dumps(run(spark, args), ensure_ascii=False, indent=2)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())

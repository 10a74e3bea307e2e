"""Command lines of the jobs."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("provenant.jobs")


def settings(job: str, path: str | None = None, **given: Any) -> dict[str, Any]:
    """A job's settings: those of its own file, over them those of ``path``, over them the arguments that are not null; unknown ones are errors."""
    own = json.loads((Path(__file__).parent / f"{job}.json").read_text(encoding="utf-8"))
    more = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    more |= {k: v for k, v in given.items() if v is not None}
    if unknown := sorted(set(more) - set(own)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return own | more


def counted(name: str, df: DataFrame) -> int:
    """The rows of a table that was read or written, logged."""
    n = df.count()
    log.info("%s: %d rows", name, n)
    return n


def main(job: str, run: Callable[..., dict[str, Any]], folders: list[str], argv: list[str] | None = None) -> int:
    """Run a job from the command line: its folders, and its settings; prints the report as JSON."""
    p = argparse.ArgumentParser(prog=job, description=(sys.modules[run.__module__].__doc__ or "").split("\n")[0])
    for name in folders:
        p.add_argument(f"--{name}", required=True, help="path on any file system that Spark reads")
    p.add_argument("--config", help="JSON file whose settings go over the job's own")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        report = run(spark, *(getattr(args, name.replace("-", "_")) for name in folders), config=settings(job, args.config))
    finally:
        spark.stop()
    sys.stdout.write(json.dumps(report, ensure_ascii=False) + "\n")
    return 0

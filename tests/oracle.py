"""Runs registered queries and their SQL side by side: python tests/oracle.py <folder of tables> [names]."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names: list[str]) -> Counter:
    """Rows as a multiset, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def compare(spark, folder: str, name: str, entry) -> str:
    """'' if both give the same rows, else what differs."""
    import duckdb

    df = entry.queries()[name](spark, folder)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = canonical(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only ours {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[6]").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    for name in sys.argv[2:] or entry.oracle_sql():
        began = time.time()
        try:
            said = compare(spark, sys.argv[1], name, entry)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
        print(name, f"{time.time() - began:.1f}", said[:700] or "ok", flush=True)

"""Ranks, running sums and values of rows before, over groups of any size without a task that sees one whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut

#: Ranges that the rows are dealt to; their counts come to the driver.
RANGES = 64
_IN_PART = (1 << 33) - 1


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank", ranges: int = RANGES) -> DataFrame:
    """The rows with their place, from 1, in ``order`` over the whole table.

    Rows are dealt to ranges of the order and sorted there; the numbered rows are cut into the shared folder, and each range
    adds the count of all before it.  ``order`` should end in something unique: rows that are equal in it are placed in any
    order, and equal rows are never split between ranges, so a leading column with few values alone makes few ranges.
    """
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    numbered = cut(dealt.withColumn("its number", F.monotonically_increasing_id()))
    part, within = F.shiftright("its number", 33), F.col("its number").bitwiseAND(F.lit(_IN_PART))
    counts = dict(numbered.groupBy(part.alias("part")).count().collect())  # a row for each range at most
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    offset = F.get(F.array(*(F.lit(n).cast("long") for n in before)), part.cast("int")) if before else F.lit(0).cast("long")
    return numbered.withColumn(name, offset + within + 1).drop("its number")


def carried(rows: DataFrame, told: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the columns that ``told`` has for each of their groups; null keys are equal."""
    named = told.withColumnsRenamed({k: f"its {k}" for k in by})
    same = reduce(Column.__and__, (rows[k].eqNullSafe(named[f"its {k}"]) for k in by))
    return rows.join(named, same, "left").drop(*(f"its {k}" for k in by))


def previous(rows: DataFrame, by: list[str], block: str, order: str, value: Column, name: str) -> DataFrame:
    """The rows with ``value`` of the row before in their group, which stands in blocks that ascend with ``order``; null for the first.

    Two passes: the last value of each block goes on to the first row of the next block that there is.
    """
    valued = rows.withColumn("its value", value)
    ends = valued.groupBy(*by, block).agg(F.max_by("its value", order).alias("end"))
    before = ends.withColumn("carry", F.lag("end").over(Window.partitionBy(*by).orderBy(block))).drop("end")
    within = Window.partitionBy(*by, block).orderBy(order)
    return carried(valued, before, [*by, block]).withColumn(name, F.when(F.row_number().over(within) == 1, F.col("carry")).otherwise(F.lag("its value").over(within))).drop("its value", "carry")


def running_count(rows: DataFrame, by: list[str], block: str, order: str, flag: Column, name: str) -> DataFrame:
    """The rows with the number of flagged rows up to them in their group, which stands in blocks that ascend with ``order``."""
    counted = rows.withColumn(name, F.sum(flag.cast("int")).over(Window.partitionBy(*by, block).orderBy(order)))
    totals = counted.groupBy(*by, block).agg(F.max(name).alias("total"))
    before = totals.withColumn("offset", F.coalesce(F.sum("total").over(Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    return carried(counted, before, [*by, block]).withColumn(name, F.col(name) + F.col("offset")).drop("offset")

"""Ranks and running sums within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlight.storage import store

#: Ranges into which values are counted at each step of a selection.
RANGES = 2048


def ranked(df: DataFrame, key: str, order: list[Column], value: str | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 1) within ``key`` by ``order`` and, where ``value`` is given, its running sum ``so_far``.

    Rows are range-partitioned by key and order, so that a key with very many rows lies in several
    partitions, its cells. Each cell is numbered by itself; the counts and sums of a key's cells before it, one
    row a cell, give what its numbers begin at. Rows with a null key are left out.
    """
    total = F.sum(F.coalesce(value, F.lit(0))) if value else F.lit(0)
    dealt = store(df.where(F.col(key).isNotNull()).repartitionByRange(F.col(key), *order).withColumn("cell", F.spark_partition_id()))
    cells = dealt.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("rows_"), total.alias("sum_"))
    before = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = store(cells.select(key, "cell", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("rows_"), F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("sum_")))
    within = Window.partitionBy(key, "cell").orderBy(*order)
    out = dealt.hint("merge").join(starts.hint("merge"), [key, "cell"]).withColumn("rank", F.col("rows_") + F.row_number().over(within))
    if value:
        out = out.withColumn("so_far", F.col("sum_") + F.sum(F.coalesce(value, F.lit(0))).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.drop("cell", "rows_", "sum_")


def _narrowed(values: DataFrame, low: int, high: int, rank: int) -> int:
    """The ``rank``-th smallest (from 1) of the whole numbers ``v``: counts of ranges, then of the one that holds it, until it is one value."""
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        part = F.floor((F.col("v") - low) / F.lit(width)).cast("long").alias("part")
        counts = values.where(F.col("v").between(low, high)).groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
        for row in counts:
            if rank <= row["n"]:
                break
            rank -= row["n"]
        low, high = low + row["part"] * width, min(high, low + (row["part"] + 1) * width - 1)
    return low


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of a column of whole numbers, nulls left out; no more than RANGES counts are held anywhere."""
    values = store(df.select(F.col(column).cast("long").alias("v")).where("v is not null"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not n:
        return None
    lower = _narrowed(values, low, high, (n + 1) // 2)
    if n % 2:
        return float(lower)
    # the next value above, unless the lower middle one is there often enough
    up_to, above = values.agg(F.count_if(F.col("v") <= lower), F.min(F.when(F.col("v") > lower, F.col("v")))).first()
    return (lower + (lower if up_to > n // 2 else above)) / 2

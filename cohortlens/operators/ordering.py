"""Global positions and running sums without a single-task window.

``orderBy`` range-partitions the rows; the staged result fixes which row sits where, so
per-partition totals (one small row per partition) can be turned into offsets and the
rest stays local to each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def _sorted_with_place(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    return stage(placed).withColumn("_part", F.shiftrightunsigned("_place", 33))


def _offsets(placed: DataFrame, totals: Sequence[Column]) -> DataFrame:
    """Running totals of all earlier partitions: one row per partition of the sort."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(*totals)
    names = [c for c in sums.columns if c != "_part"]
    return sums.select(
        "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names]
    )


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1..n over the whole table in the given (total) order."""
    placed = _sorted_with_place(df, order)
    offsets = _offsets(placed, [F.count(F.lit(1)).alias("_offset")])
    local = F.col("_place").bitwiseAND((1 << 33) - 1)
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per sort partition
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_place", "_part", "_offset")
    )


def running_sums(df: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_before``: the sum over all earlier rows in the given (total) order."""
    placed = _sorted_with_place(df, order)
    offsets = _offsets(placed, [F.sum(c).alias(f"_o_{c}") for c in columns])
    earlier = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "_part")  # one row per sort partition
    for c in columns:
        local = F.coalesce(F.sum(c).over(earlier), F.lit(0))
        out = out.withColumn(f"{c}_before", F.col(f"_o_{c}") + local)
    return out.drop("_place", "_part", *[f"_o_{c}" for c in columns])

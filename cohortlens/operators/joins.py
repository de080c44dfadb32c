"""Attendance to application matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` per key (null is a key of its own).

    First the least ``order`` of each key, from two columns alone and combined map-side, so a
    key held by a third of all rows stays cheap; then the rows that have it. Rows that share
    key and order, if there are any, are settled among themselves by their other columns.
    """
    least = df.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min(f"`{order}`").alias("_least"))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_key")) & F.col(f"`{order}`").eqNullSafe(F.col("_least"))
    found = df.join(least, same, "left_semi")
    rest = [c for c in df.columns if c not in (key, order)]
    row = F.struct(*[F.col(f"`{c}`") for c in (order, *rest)])
    return found.groupBy(key).agg(F.min(row).alias("_first")).select(key, "_first.*").select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def join_attendance(attendance: DataFrame, applications: DataFrame, order: str) -> DataFrame:
    """Left join on the trimmed lower-case project name, at most one match per row.

    The application side keeps its first row per name, so nothing fans out. Its year,
    cohort and name are dropped. Missing names match nothing.
    """
    if "project_name" not in applications.columns or "matched_project_name" not in attendance.columns:
        return attendance
    named = applications.withColumn("_project", F.lower(strip(F.col("project_name")))).filter(
        F.col("_project").isNotNull()
    )
    right = first_per_key(named, "_project", order).drop("year", "cohort", "project_name", order)
    left = attendance.withColumn("_project", F.lower(strip(F.col("matched_project_name"))))
    clash = [c for c in right.columns if c in left.columns and c != "_project"]
    return left.join(right.drop(*clash), "_project", "left").drop("_project")


def matched_count(joined: DataFrame, column: str = "Sector") -> DataFrame:
    return joined.agg(F.count(F.col(column)).alias("matched"), F.count(F.lit(1)).alias("rows"))

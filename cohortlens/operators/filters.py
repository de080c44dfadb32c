"""Row filters, filter options and outcome stripping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ARABIC_NARROW, has_script

FILTER_COLUMNS = {
    "years": "year",
    "cohorts": "cohort",
    "outcomes": "outcome_clean",
    "sectors": "Sector",
    "types": "applicant_type",
}
# Columns that reveal the outcome and must never reach a model.
OUTCOME_COLUMNS = ("outcome", "outcome_clean", "is_winner")


def apply_filters(df: DataFrame, strict: bool = True, **selected: Sequence) -> DataFrame:
    """Keep rows whose value is in every non-empty list; null never matches.

    With ``strict=False`` absent columns are skipped and the type filter falls back to
    the raw ``individual_or_team`` text.
    """
    unknown = set(selected) - set(FILTER_COLUMNS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for name, column in FILTER_COLUMNS.items():
        values = selected.get(name)
        if not values:
            continue
        if not strict and column not in df.columns:
            if column != "applicant_type" or "individual_or_team" not in df.columns:
                continue
            column = "individual_or_team"
        df = df.filter(F.col(column).isin(*values))
    return df


def filter_options(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column)).dropna().distinct().orderBy(column)


def strip_outcomes(df: DataFrame) -> DataFrame:
    return df.drop(*OUTCOME_COLUMNS)


def assert_no_leak(columns: Sequence[str]) -> None:
    leaked = sorted(set(columns) & set(OUTCOME_COLUMNS))
    if leaked:
        raise ValueError(f"outcome columns may not be model inputs: {leaked}")


def scope_years(df: DataFrame, years: Sequence[int] = (2024, 2025)) -> DataFrame:
    return df.filter(F.col("year").isin(*years))


def english_pool() -> Column:
    return F.col("problem_en").isNotNull() & F.col("solution_en").isNotNull()


def original_pool(script: str = ARABIC_NARROW) -> Column:
    return has_script(F.col("problem"), script) & F.col("solution").isNotNull()


def idea_pools(df: DataFrame, script: str = ARABIC_NARROW) -> DataFrame:
    """One row per idea and pool it can be sampled from: 'en' and 'ar'."""
    pools = F.array_compact(
        F.array(F.when(english_pool(), "en"), F.when(original_pool(script), "ar"))
    )
    return df.withColumn("pool", F.explode(pools))

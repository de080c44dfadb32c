"""Repeat submissions: the same idea under more than one cohort of a year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import clean_applicant_type
from ..functions.text import strip, text_value

REPEAT_SCHEMA = (
    "project_name string, year int, cohort_1 string, cohort_2 string, sector_1 string, "
    "sector_2 string, stage_1 string, stage_2 string, outcome_1 string, outcome_2 string, "
    "applicant_type string, idea_text string"
)
# Preferred and fallback column of each attribute.
ATTRIBUTES = {
    "sector": ("Sector", "sector"),
    "stage": ("Business Stage", "stage"),
    "outcome": ("outcome_clean", "outcome"),
    "type": ("applicant_type", "individual_or_team"),
    "problem": ("problem_en", "problem"),
    "solution": ("solution_en", "solution"),
}


def _pick(df: DataFrame, choices: Sequence[str]) -> Column:
    for c in choices:
        if c in df.columns:
            return text_value(F.col(f"`{c}`"))
    return F.lit("")


def repeat_submissions(
    df: DataFrame,
    order: str,
    years: Sequence[int] = (),
    sectors: Sequence[str] = (),
    outcomes: Sequence[str] = (),
    types: Sequence[str] = (),
) -> DataFrame:
    """First and latest round of every repeated idea side by side.

    One grouped pass over cohorts and row numbers: an identity repeats when its smallest and
    largest cohort differ, and its first and latest rows are the extremes of one struct. All
    of it combines map-side, so a heavily repeated identity is no hot spot. Texts and labels
    are then fetched for those two rows alone, by ``order``, which must be unique. Filters
    test the latest row.
    """
    if not {"year", "project_name", "cohort_id"} <= set(df.columns):
        return df.sparkSession.createDataFrame([], REPEAT_SCHEMA)
    identity = strip(F.coalesce("project_name", F.lit("")))
    if "date_of_birth" in df.columns:
        identity = F.concat_ws("|", identity, strip(F.coalesce("date_of_birth", F.lit(""))))
    row = F.struct(
        F.col("cohort_id").isNull().alias("_late"),  # a missing cohort sorts last
        F.col("cohort_id").alias("cohort_id"),
        F.col(order).alias("row"),
    )
    if years:
        df = df.filter(F.col("year").isin(*years))
    groups = (
        df.select(F.col("year"), identity.alias("_identity"), row.alias("_row"))
        .groupBy("year", "_identity")
        .agg(
            F.min("_row.cohort_id").alias("_lo"),
            F.max("_row.cohort_id").alias("_hi"),
            F.min("_row").alias("first"),
            F.max("_row").alias("latest"),
        )
        .filter(F.col("_lo") != F.col("_hi"))
    )
    picked = {name: _pick(df, choices).alias(name) for name, choices in ATTRIBUTES.items()}
    for side, wanted in (("first", ("sector", "stage", "outcome")), ("latest", tuple(ATTRIBUTES))):
        values = F.struct(F.col("cohort_id"), F.col("project_name").alias("name"), *(picked[name] for name in wanted))
        rows = df.select(F.col(order).alias("_row"), values.alias("_values"))
        groups = groups.join(rows, F.col(f"{side}.row") == F.col("_row")).withColumn(side, F.col("_values")).drop("_row", "_values")
    applicant_type = clean_applicant_type(F.col("latest.type"))
    for column, values in (
        (F.col("latest.sector"), sectors),
        (F.col("latest.outcome"), outcomes),
        (applicant_type, types),
    ):
        if values:
            groups = groups.filter(column.isin(*values))
    problem, solution = F.col("latest.problem"), F.col("latest.solution")
    both = F.array_join(F.filter(F.array(problem, solution), lambda x: x != ""), "\n")
    pairs = [
        F.col(f"{side}.{name}").alias(f"{name}_{i}")
        for name in ("sector", "stage", "outcome")
        for i, side in ((1, "first"), (2, "latest"))
    ]
    return groups.select(
        text_value(F.col("first.name")).alias("project_name"),
        "year",
        text_value(F.col("first.cohort_id")).alias("cohort_1"),
        text_value(F.col("latest.cohort_id")).alias("cohort_2"),
        *pairs,
        applicant_type.alias("applicant_type"),
        both.alias("idea_text"),
    )

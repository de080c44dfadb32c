"""Readers, dataset recognition, loaders and result writers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import clean_applicant_type, clean_cohort, to_year

# The columns a table is recognised and narrowed by.
APPLICATION_COLUMNS = (
    "year", "cohort", "cohort_id", "Sector", "outcome_clean", "Business Stage", "Age Group",
    "applicant_type", "team_member_count", "employment_status", "has_commercial_registration",
    "education", "major", "nationality",
)
APPLICATION_EXTRAS = ("project_name", "individual_or_team")
ATTENDANCE_METRICS = (
    "sessions_scheduled", "team_days_present", "team_days_virtual", "team_attendance_rate",
    "member_attendance_rate", "attendance_member_rows", "member_days_present",
    "member_days_virtual", "team_size_from_attendance",
)
ATTENDANCE_COLUMNS = (
    *ATTENDANCE_METRICS, "year", "cohort", "matched_project_name", "matched_application_id",
)
MODEL_INPUT_COLUMNS = (
    "project_name", "date_of_birth", "individual_or_team", "problem", "solution",
    "in_two_cohorts", "sector_all",
)

APPLICATION_SCHEMA = T.StructType(
    [T.StructField("project_name", T.StringType())]
    + [
        T.StructField(c, T.IntegerType() if c == "year" else T.StringType())
        for c in APPLICATION_COLUMNS
    ]
    + [T.StructField("individual_or_team", T.StringType())]
)
ATTENDANCE_SCHEMA = T.StructType(
    [
        T.StructField(c, T.DoubleType() if c.endswith("_rate") else T.IntegerType())
        for c in ATTENDANCE_METRICS
    ]
    + [
        T.StructField("year", T.IntegerType()),
        T.StructField("cohort", T.StringType()),
        T.StructField("matched_project_name", T.StringType()),
        T.StructField("matched_application_id", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Parquet, JSON or CSV by ending; CSV may hold quoted multi-line text and a BOM.

    CSV columns are matched to ``schema`` by header name, so their order is free. With
    ``multi_line`` a JSON file is one array or object, and a file is one task's work; without
    it JSON has an object and CSV a row on each line, and large files are split among tasks.
    """
    if path.endswith(".json"):
        return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=multi_line)
    if not path.endswith(".csv"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    df = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
    if schema is None:
        return df
    types = {f.name: f.dataType for f in schema.fields}
    return df.select(
        *[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns]
    )


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column a string and no value read as missing."""
    df = spark.read.csv(
        path, header=True, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue=""
    )
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def match_dataset(
    frames: Iterable[DataFrame], columns: Sequence[str], min_match: int = 3
) -> DataFrame:
    """First frame that has at least ``min_match`` of the known columns."""
    for df in frames:
        if len(set(columns) & set(df.columns)) >= min_match:
            return df
    raise ValueError("no table has the expected columns: " + ", ".join(list(columns)[:6]))


def has_model_schema(df: DataFrame) -> bool:
    return set(MODEL_INPUT_COLUMNS) <= set(df.columns)


def choose_model_table(frames: Sequence[DataFrame]) -> DataFrame:
    """The first frame with the model's inputs, or the first frame at all."""
    return next((df for df in frames if has_model_schema(df)), frames[0])


def narrow(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the known columns that are present, in the known order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def normalize_shared(df: DataFrame) -> DataFrame:
    cleaners = {"year": to_year, "cohort": clean_cohort, "applicant_type": clean_applicant_type}
    present = {c: f(F.col(c)) for c, f in cleaners.items() if c in df.columns}
    return df.withColumns(present) if present else df


def derive_type(df: DataFrame) -> DataFrame:
    if "applicant_type" in df.columns or "individual_or_team" not in df.columns:
        return df
    return df.withColumn("applicant_type", clean_applicant_type(F.col("individual_or_team")))


def load_applications(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Recognise, narrow and clean an applications table; ``keep`` names further columns."""
    match_dataset([df], APPLICATION_COLUMNS)
    columns = [*keep, *APPLICATION_COLUMNS, *APPLICATION_EXTRAS]
    return derive_type(normalize_shared(narrow(df, columns)))


def load_attendance(df: DataFrame) -> DataFrame:
    match_dataset([df], ATTENDANCE_METRICS)
    return normalize_shared(narrow(df, ATTENDANCE_COLUMNS))


def merge_cache(cache: DataFrame, new: DataFrame, key: str = "identity", score: str = "score") -> DataFrame:
    """Resume a scoring run: cached scores stay, unscored or absent identities come from ``new``."""
    done = cache.filter(F.col(score).isNotNull())
    fresh = new.join(done.select(key), key, "left_anti")
    stale = cache.filter(F.col(score).isNull()).join(new.select(key), key, "left_anti")
    return done.unionByName(fresh).unionByName(stale)


def write_result(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write JSON, CSV or Parquet by ending; the folder holds one file per partition."""
    writer = df.write.mode(mode)
    if path.endswith(".json"):
        writer.json(path)
    elif path.endswith(".csv"):
        writer.csv(path, header=True, escape='"')
    else:
        writer.parquet(path)

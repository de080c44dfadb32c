"""Reading the corpus tables and the defaults all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name with dots or blanks as one identifier."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``row``, so that no name clashes with an operator's own."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")


def field(name: str) -> Column:
    """A column out of ``row``, under its own name."""
    return F.col("row." + quoted(name)).alias(name)

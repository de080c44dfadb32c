import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from cohortlens.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "cohortlens-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a one-row frame."""

    def run(*columns, **values):
        from pyspark.sql import functions as F

        df = spark.range(1)
        for name, value in values.items():
            df = df.withColumn(name, F.lit(value) if value is not None else F.lit(None).cast("string"))
        row = df.select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run

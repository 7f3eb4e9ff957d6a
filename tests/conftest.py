from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cutline.session import builder

    session = (
        builder("tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Make a frame from a schema and rows; missing trailing values are NULL."""

    def make(schema: str, rows: list):
        width = len(schema.split(", "))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


@pytest.fixture
def one(spark):
    """Value of a Column or of SQL text over literals."""

    def evaluate(column):
        from pyspark.sql import functions as F

        column = F.expr(column) if isinstance(column, str) else column
        return spark.range(1).select(column.alias("v")).first()[0]

    return evaluate

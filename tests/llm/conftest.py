"""Tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import pytest

from odd_documents import COLUMNS, rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with extra columns that have the names of results and of intermediate columns."""
    from pyspark.sql import functions as F

    names = ("shard", "slot", "copy", "kept", "keep_id", "name", "level", "hash", "node", "n", "count", "rate", "_row", "_h", "_n", "ids", "licence", "spans", "row_key", "model_lang", "component")
    return odd.select("*", *[F.lit("x").alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)

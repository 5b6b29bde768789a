import pytest
from pyspark.sql import functions as F
from text_tables import ROWS, SCHEMA, documents


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated ids and rows, and columns whose names operators use."""
    return documents(spark, ROWS).withColumns({c: F.lit("clash") for c in ("d", "n", "size", "target", "copies", "score", "base", "added", "block", "shard", "piece", "label")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

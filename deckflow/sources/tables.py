"""Stored tables of the pipeline, as Parquet folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where nothing was written yet."""
    try:
        found = spark.read.schema(schema).parquet(path)
        found.schema  # a remote session looks at the path only now
        return found
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)

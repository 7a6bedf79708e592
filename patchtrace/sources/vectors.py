"""Embedding files (S4 scan, S9 sink) in the reference's shape or as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VECTOR_SCHEMA = "path string, embedding array<double>"


def read_vectors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(path, embedding) records.

    ``fmt="json_array"`` reads files holding one JSON array of records (the reference's
    output shape; each file is parsed whole, so keep such files moderate); ``"json"``
    reads JSON lines (our sink's output, splittable); ``"parquet"`` is the default."""
    if fmt == "json_array":
        return spark.read.schema(VECTOR_SCHEMA).option("multiLine", True).json(path)
    if fmt == "json":
        return spark.read.schema(VECTOR_SCHEMA).json(path)
    return spark.read.schema(VECTOR_SCHEMA).parquet(path)

"""Scoring streams: a model is one stateless projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from timberline.plans.model import Forest


def read_scored(spark: SparkSession, path: str, schema: StructType | str, forest: Forest, raw: bool = True, threshold: float | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files below ``path``, with a column ``score``."""
    source = spark.readStream.schema(schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    return forest.scored(source.parquet(path), raw, threshold)

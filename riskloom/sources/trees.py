"""Tree dumps: one JSON document per tree."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trees_from_strings(spark: SparkSession, dumps: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(dumps)), "tree_id long, tree string")


def trees_from_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line of the text files under `path`."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("tree_id"), F.col("value").alias("tree"))

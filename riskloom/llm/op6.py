"""op6: delete later repeated runs of lines from `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .linededup import dedup_lines


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "removed_lines", "text")


QUERIES = {"op6_line_dedup": line_dedup}
SQL: dict[str, str] = {}

"""op1: toxicity score of every document of `documents`, learned from `labels.toxic`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table
from .toxicity import fit, score


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents.

    Labels of rows whose id has CRC-32 mod 4 = 2 are never read. NULL text counts as empty and is
    scored like any other. Repeated rows get the same score.
    """
    docs = table(spark, folder, "documents").select(
        "doc_id", (crc_of_id("doc_id") % 4 == 2).alias("held_out"), "text"
    )
    labels = table(spark, folder, "labels").where(crc_of_id("doc_id") % 4 != 2).select("doc_id", "toxic")
    weights = fit(docs.where(~F.col("held_out")), labels, "doc_id", "text", "toxic")
    scored = score(docs, weights, "doc_id", "text", ["held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op1_toxicity_scores": toxicity_scores}
SQL: dict[str, str] = {}

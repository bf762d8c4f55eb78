"""op4: quality score of every document of `documents`, learned from `labels.quality`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import crc_of_id, table
from .ranking import CUT_AT, learn_ranker, squeezed
from .textstats import STATISTICS, ratios, with_statistics


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents.

    NULL text counts as empty; empty texts have all features 0 and get a score like any other.
    Labels of rows whose id has CRC-32 mod 5 = 0 are never read.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    features = squeezed(ratios())
    stats = write_shared(
        with_statistics(docs)
        .select("doc_id", *STATISTICS)
        .select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), *[c.alias(f) for f, c in features.items()])
    )
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    taught = stats.where(~F.col("held_out")).join(labels, "doc_id")
    ranker = learn_ranker(taught, list(features), "quality", "doc_id")
    scored = stats.select("doc_id", "held_out", ranker.score({f: F.col(f) for f in features}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT_AT).cast("int"))


QUERIES = {"op4_quality_scores": quality_scores}
SQL: dict[str, str] = {}

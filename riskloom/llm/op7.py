"""op7: near-duplicate components of `documents` by shingle overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import table
from .jaccard import component_rows, jaccard_components


def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of `docs`, columns unchanged.

    The row with the smallest id stays, a missing id coming last; of several texts under one id in a
    component the one with the smaller hash, of repeated rows one. Rows without words all stay.
    """
    found = write_shared(component_rows(docs.select("doc_id", "text")).where("component IS NOT NULL"))
    row = F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "key")
    first = found.groupBy("component").agg(F.min(row).alias("first"))
    # one row per (id, text), so that a key with many repeated rows is one row before any join
    keys = found.groupBy("doc_id", "key", "component").agg(F.count(F.lit(1)).alias("rows"))
    judged = keys.join(first, "component").withColumn("stays", row == F.col("first"))
    gone = write_shared(judged.where("NOT stays").select("doc_id", "key").distinct())
    twice = write_shared(judged.where("stays AND rows > 1").select("doc_id", "key").distinct())
    texts = docs.withColumn("__key", F.xxhash64("text"))
    id_ = F.col("doc_id").cast("long")

    def among(marks: DataFrame):
        marks = marks.select(F.col("doc_id").alias("__id"), F.col("key").alias("__mark"))
        return marks, id_.eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__mark"))

    left = texts.join(*among(gone), "left_anti")
    once = left.join(*among(twice), "left_anti")
    repeated = left.join(*among(twice), "left_semi").dropDuplicates(["doc_id", "__key"])
    return once.unionAll(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op7_ngram_jaccard": ngram_jaccard}
SQL: dict[str, str] = {}

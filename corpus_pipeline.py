"""A corpus pipeline: quality rules, line dedup, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of `documents`; the last one returns the pieces of the packed sequences. Between stages the
rows are written as Parquet in the session's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import table
from riskloom.llm.linededup import dedup_lines
from riskloom.llm.op7 import one_of_each
from riskloom.llm.op8 import mixed_documents
from riskloom.llm.op9 import packed
from riskloom.llm.op10 import keep_good
from riskloom.sources.shared import write_shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in docs.columns]
    cut = dedup_lines(docs)
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixing),
    ("packing", packing),
]

#: The learned rules, the tokenizer and the curve have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""op10: quality rules over `documents`, learned from `labels.quality`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import table
from .rules import DecisionList, learn_decision_list
from .textstats import STATISTICS, ratios, with_statistics

PREFIX = "__q_"


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def learn_quality_rules(stats: DataFrame, labels: DataFrame, prefix: str = "") -> DecisionList:
    """The decision list from statistics (doc_id and the prefixed columns) and labels(doc_id, quality).

    Rows that fail the base rule teach nothing: the list judges only rows that pass it.
    """
    features = ratios(prefix)
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality")
    rows = stats.where(~base_failed(prefix)).select("doc_id", *[c.alias(f) for f, c in features.items()])
    return learn_decision_list(rows.join(known, "doc_id"), list(features), "quality", "doc_id")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every row of documents.

    NULL and empty texts have no word and fail the base rule. Repeated rows are judged alike.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stats = write_shared(with_statistics(docs).select("doc_id", *STATISTICS))
    rules = learn_quality_rules(stats, table(spark, folder, "labels"))
    failed = base_failed()
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~rules.rejects(ratios())).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that pass the base rule and the list learned on them, columns unchanged.

    Texts are read once: the rows are written with their statistics, learned from and judged there.
    """
    stats = write_shared(with_statistics(docs, prefix=PREFIX))
    rules = learn_quality_rules(stats, labels, PREFIX)
    good = ~base_failed(PREFIX) & ~rules.rejects(ratios(PREFIX))
    return stats.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op10_quality_rules": quality_rules}
SQL: dict[str, str] = {}

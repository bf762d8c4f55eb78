"""op12: the language of every document, learned from `documents.lang`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, table
from .langid import UNDETERMINED, identify, learn_dictionaries


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of documents.

    The score is the share of bytes that the chosen dictionary saves over the runner-up. A rejected
    choice keeps its language in lang_pred.
    """
    docs = table(spark, folder, "documents")
    held_out = (F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2).alias("held_out")
    learned = learn_dictionaries(docs.select("text", "lang", held_out).where("NOT held_out"))
    found = identify(docs.select("doc_id", held_out, "text"), learned)
    return found.select(
        "doc_id",
        "held_out",
        F.col("best_lang").alias("lang_pred"),
        F.col("lang_margin").alias("score"),
        (F.col("detected_lang").isNull() & (F.col("best_lang") != UNDETERMINED)).alias("rejected"),
    )


QUERIES = {"op12_language_id": language_id}
SQL: dict[str, str] = {}

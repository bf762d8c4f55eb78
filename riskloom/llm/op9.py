"""op9: pack the token ids of `documents` into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path(), token_ids=False)


def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"op9_packed_sequences": packed_sequences}
SQL: dict[str, str] = {}

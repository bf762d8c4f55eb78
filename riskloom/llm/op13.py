"""op13: alignment of two public tokenizers on `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.shared import write_shared

from .alignment import align_documents, link_counts
from .common import table


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = write_shared(align_documents(docs, *tokenizer_paths(), groups=False).drop("groups"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return link_counts(aligned).select(*columns)


QUERIES = {"op13_tokenizer_alignment": tokenizer_alignment}
SQL: dict[str, str] = {}

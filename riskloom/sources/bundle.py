"""Result bundles: a dictionary of named tables written to, and read from, one folder."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


def write_bundle(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def read_bundle(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}

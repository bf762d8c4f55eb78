"""Node and edge tables of a variable-cluster graph."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import require


def clusters_frame(spark: SparkSession, correlations: Mapping[str, Iterable[str]]) -> DataFrame:
    """(ordre, representant, correlees) from a mapping, keeping its order."""
    rows = [(i, key, list(values)) for i, (key, values) in enumerate(correlations.items())]
    return spark.createDataFrame(rows, "ordre long, representant string, correlees array<string>")


def graph_nodes(clusters: DataFrame) -> DataFrame:
    """(id, type): a variable that is ever a key is a representative, else correlated."""
    require(clusters, "representant", "correlees")
    named = clusters.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.col("representant").alias("id"), F.lit(1).alias("key"))),
                F.transform("correlees", lambda v: F.struct(v.alias("id"), F.lit(0).alias("key"))),
            )
        ).alias("n")
    ).select("n.*")
    kind = F.when(F.max("key") == 1, F.lit("representant")).otherwise(F.lit("correlee"))
    return named.groupBy("id").agg(kind.alias("type"))


def graph_edges(clusters: DataFrame) -> DataFrame:
    """(a, b, rang, poids, largeur) per unordered pair; a repeated pair keeps its last rank."""
    require(clusters, "ordre", "representant", "correlees")
    links = clusters.select("ordre", "representant", F.posexplode("correlees").alias("place", "autre"))
    rang = (F.col("place") + 1).alias("rang")
    last = F.max_by(F.col("rang"), F.struct("ordre", "place"))
    return (
        links.select("ordre", "place", rang, F.least("representant", "autre").alias("a"), F.greatest("representant", "autre").alias("b"))
        .groupBy("a", "b")
        .agg(last.alias("rang"))
        .select("a", "b", "rang", (1.0 / F.col("rang")).alias("poids"), (3.0 / F.col("rang")).alias("largeur"))
    )

"""Synthetic loan portfolios, generated in parallel from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Level shares and default probabilities of the categorical portfolio.
CONTRACT_SHARES = {"CDI": 0.6, "CDD": 0.3, "Freelance": 0.1}
CONTRACT_RISK = {"CDI": 0.05, "CDD": 0.12, "Freelance": 0.18}

# Log-normal income and the logistic default curve of the numeric portfolio.
INCOME_MU, INCOME_SIGMA = 7.5, 0.8
RISK_CENTRE, RISK_SCALE = 1500.0, 500.0

FIRST_MONTH, N_MONTHS = "2024-01-01", 12


def _month(seed: int) -> Column:
    shift = F.floor(F.rand(seed) * N_MONTHS).cast("int")
    return F.date_format(F.add_months(F.lit(FIRST_MONTH).cast("date"), shift), "yyyy-MM")


def categorical_portfolio(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """(type_contrat, mois_octroi, defaut)."""
    draw = F.col("u")
    names = list(CONTRACT_SHARES)
    bound, chain = 0.0, None
    for name in names[:-1]:
        bound += CONTRACT_SHARES[name]
        chain = F.when(draw < bound, name) if chain is None else chain.when(draw < bound, name)
    risk = F.create_map(*[F.lit(x) for pair in CONTRACT_RISK.items() for x in pair])
    return (
        spark.range(n)
        .select(F.rand(seed).alias("u"), _month(seed + 1).alias("mois_octroi"), F.rand(seed + 2).alias("v"))
        .select(chain.otherwise(names[-1]).alias("type_contrat"), "mois_octroi", "v")
        .select(
            "type_contrat",
            "mois_octroi",
            (F.col("v") < F.element_at(risk, F.col("type_contrat"))).cast("int").alias("defaut"),
        )
    )


def numeric_portfolio(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """(revenu, mois_octroi, defaut)."""
    risk = 1 / (1 + F.exp((F.col("revenu") - RISK_CENTRE) / RISK_SCALE))
    return (
        spark.range(n)
        .select(
            F.exp(INCOME_MU + INCOME_SIGMA * F.randn(seed)).alias("revenu"),
            _month(seed + 1).alias("mois_octroi"),
            F.rand(seed + 2).alias("v"),
        )
        .select("revenu", "mois_octroi", (F.col("v") < risk).cast("int").alias("defaut"))
    )

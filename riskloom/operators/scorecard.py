"""Scorecard: points and contribution per variable and level of a logistic model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .levels import levels_by_variable


def summarize_model(df: DataFrame, target: str, coefficients: DataFrame) -> DataFrame:
    """(variable, level, taux_cible, taux_pop, coef, pvalue, ecart_relatif, points_1000,
    contribution) for the variables of the model.

    `df` is the training table with the original variables; `coefficients` holds (variable,
    level, coef, pvalue). A level without a coefficient, such as the base, scores 0. The points
    scale is the largest coefficient per variable, the base level not counted.
    """
    variables = [row[0] for row in coefficients.select("variable").distinct().collect()]
    variables.sort()
    levels = levels_by_variable(df, variables, target)
    rows = df.agg(F.count(F.lit(1))).scalar()
    tops = coefficients.groupBy("variable").agg(F.max("coef").alias("coef_max"))
    scale = tops.agg(F.sum("coef_max")).scalar()
    joined = (
        levels.join(tops, "variable")
        .join(coefficients.select("variable", "level", "coef", "pvalue"), ["variable", "level"], "left")
        .select(
            "variable",
            "level",
            (ratio(F.col("nb_defaut"), F.col("n_cible")) * 100).alias("taux_cible"),
            (ratio(F.col("effectif"), rows) * 100).alias("taux_pop"),
            F.coalesce(F.col("coef"), F.lit(0.0)).alias("coef"),
            "pvalue",
            "coef_max",
        )
        .withColumn("points_1000", F.try_divide(1000 * (F.col("coef_max") - F.col("coef")), scale))
    )
    # a variable in the model has one coefficient column per level, so its level list is short
    by_risk = W.partitionBy("variable").orderBy(F.col("taux_cible").asc_nulls_last(), F.col("level"))
    following = F.lead("taux_cible").over(by_risk)
    largest = F.max("points_1000").over(W.partitionBy("variable"))
    return joined.select(
        "variable",
        "level",
        "taux_cible",
        "taux_pop",
        "coef",
        "pvalue",
        ((ratio(following, F.col("taux_cible")) - 1) * 100).alias("ecart_relatif"),
        "points_1000",
        (F.greatest(largest, F.lit(0.0)) / 10).alias("contribution"),
    )

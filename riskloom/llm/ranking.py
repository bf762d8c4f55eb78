"""Quality scores by pairwise ranking after Bradley and Terry.

Every pair of a good and a bad document is a preference; the probability that the good one wins is
the logistic function of the difference of two linear scores. The weights come from logistic
regression without intercept on feature differences. Scores are cut at the quantile that the share
of bad documents among the labelled rows names, and mapped to 0..1 so that the cut lies at a
given probability.

Pairs are drawn by hash: both classes are dealt to as many slots as the larger class has rows, in
several rounds, and meet inside a slot, so a slot holds a few rows and no group is paired out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

ROWS_PER_CLASS = 40_000  # bound of the labelled sample that pairs are drawn from
ROUNDS = 8
CUT_AT = 0.3


@dataclass(frozen=True)
class Ranker:
    features: Sequence[str]
    means: Sequence[float]
    scales: Sequence[float]
    weights: Sequence[float]
    cut: float

    def linear(self, columns: dict[str, Column]) -> Column:
        out = F.lit(0.0)
        for f, m, s, w in zip(self.features, self.means, self.scales, self.weights):
            out = out + (columns[f] - m) * (w / s)
        return out

    def score(self, columns: dict[str, Column]) -> Column:
        """Between 0 and 1; CUT_AT at the cut."""
        z = self.linear(columns) - self.cut + math.log(CUT_AT / (1 - CUT_AT))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def squeezed(columns: dict[str, Column]) -> dict[str, Column]:
    """Features on a scale where a few extreme texts do not set the spread."""
    return {f: F.log1p(F.greatest(c, F.lit(0.0)) * 20) for f, c in columns.items()}


def learn_ranker(rows: DataFrame, features: Sequence[str], label: str, id_column: str) -> Ranker:
    """Learn from rows of (id, 0/1 label, features); other labels are left out.

    Means, deviations and the cut cover all rows; the pairs come from at most about ROWS_PER_CLASS
    rows of each class, chosen by hash. With one class only, all weights are 0 and so is the cut.
    """
    table = write_shared(
        rows.where(F.col(label).isin(0, 1)).select(
            F.col(id_column).alias("id"), F.col(label).cast("int").alias("y"), *features
        )
    )
    sums = table.agg(
        F.coalesce(F.sum("y"), F.lit(0)).alias("good"),
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"m_{f}") for f in features],
        *[F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias(f"s_{f}") for f in features],
    ).first()
    means = [sums[f"m_{f}"] for f in features]
    scales = [sums[f"s_{f}"] or 1.0 for f in features]
    good, bad = sums["good"], sums["n"] - sums["good"]
    if not good or not bad:
        return Ranker(features, means, scales, [0.0] * len(features), 0.0)
    x = F.array(*[(F.col(f) - m) / s for f, m, s in zip(features, means, scales)])
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) / 1e6
    sampled = table.where(
        chance < F.when(F.col("y") == 1, F.lit(ROWS_PER_CLASS / good)).otherwise(F.lit(ROWS_PER_CLASS / bad))
    )
    slots = int(max(1, min(ROWS_PER_CLASS, max(good, bad))))
    dealt = (
        sampled.select("id", "y", x.alias("x"), F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))).alias("round"))
        .withColumn("slot", F.pmod(F.xxhash64("round", "id", "y"), F.lit(slots)))
    )
    wins = dealt.where("y = 1").select("round", "slot", F.col("x").alias("w"))
    losses = dealt.where("y = 0").select("round", "slot", F.col("x").alias("l"))
    flip = F.col("round") % 2 == 0
    pairs = wins.join(losses, ["round", "slot"]).select(
        flip.cast("double").alias("label"),
        array_to_vector(
            F.zip_with("w", "l", lambda a, b: F.when(flip, a - b).otherwise(b - a))
        ).alias("features"),
    )
    pairs = write_shared(pairs)
    if pairs.select("label").distinct().count() < 2:
        return Ranker(features, means, scales, [0.0] * len(features), 0.0)
    fit = LogisticRegression(
        fitIntercept=False, standardization=False, regParam=1e-3, maxIter=60, tol=1e-7
    ).fit(pairs)
    ranker = Ranker(features, means, scales, [float(v) for v in fit.coefficients], 0.0)
    share = bad / (good + bad)
    around = (
        table.select(ranker.linear({f: F.col(f) for f in features}).alias("s"))
        .agg(F.percentile_approx("s", [share, min(1.0, share + 0.01)], 10_000))
        .first()[0]
    )
    return Ranker(features, means, scales, ranker.weights, sum(around) / 2)

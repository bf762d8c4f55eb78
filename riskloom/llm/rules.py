"""Quality rules as a learned decision list.

Sequential covering: a rule grows condition by condition on two thirds of the labelled rows,
always by the threshold with the largest information gain, is pruned on the remaining third, and
the rows it covers leave the table before the next rule. The result is an ordered list of threshold
conjunctions that becomes one `CASE WHEN` expression, so applying it needs no shuffle.

Learning reads every labelled row once, into counts per combination of feature bins; each step is
one aggregate of that table and sends only (features x bins) rows to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

CUT_SHARES = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > cut, else feature <= cut
    cut: float
    bin: int  # rows in a bin >= this one are above the cut

    def column(self, features: Mapping[str, Column]) -> Column:
        value = features[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def binned(self) -> Column:
        value = F.col(f"bin_{self.feature}")
        return value >= self.bin if self.above else value < self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rejecting rules; a row that fits none is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self, features: Mapping[str, Column]) -> Column:
        """True where a rule fits; never NULL. The first fitting rule decides."""
        verdict = F.when(F.lit(False), F.lit(False))
        for rule in self.rules:
            verdict = verdict.when(_all([c.column(features) for c in rule]), F.lit(True))
        return F.coalesce(verdict.otherwise(F.lit(False)), F.lit(False))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def _gain(p: int, n: int, before_p: int, before_n: int) -> float:
    if p == 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(before_p / (before_p + before_n)))


def learn_decision_list(
    labelled: DataFrame,
    features: Sequence[str],
    label: str,
    id_column: str,
    max_rules: int = 8,
    max_conditions: int = 3,
    least_precision: float = 0.9,
    least_covered: int = 3,
) -> DecisionList:
    """Learn rules that reject rows with label 0 from all rows of `labelled`.

    Rows with a NULL label take no part; a NULL or NaN feature counts as 0. `id_column` deals rows
    to the growing and the pruning part by its hash. A rule is accepted if on the pruning part it
    covers at least `least_covered` rows of label 0 at the given precision. Without labelled rows
    of both classes the list is empty.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        *[F.coalesce(F.nanvl(F.col(f), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features],
        (F.col(label) == 0).cast("long").alias("bad"),
        (F.pmod(F.xxhash64(F.lit("prune"), F.col(id_column)), F.lit(3)) == 0).alias("prune"),
    )
    rows = write_shared(rows)
    found = rows.agg(
        *[F.percentile_approx(f, CUT_SHARES, 10_000).alias(f) for f in features],
        *[
            F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), CUT_SHARES, 10_000).alias(f"bad_{f}")
            for f in features
        ],
    ).first()
    values = {f: sorted({*(found[f] or []), *(found[f"bad_{f}"] or [])}) for f in features}
    # thresholds lie halfway between neighbouring quantiles, away from the rows on both sides
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}
    counted = rows.select(
        "bad",
        "prune",
        *[
            sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f"bin_{f}")
            for f in features
        ],
    )
    left = write_shared(
        counted.groupBy("prune", *[f"bin_{f}" for f in features]).agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
        )
    )
    rules: list[list[Condition]] = []
    while len(rules) < max_rules:
        rule = _grow(left.where(~F.col("prune")), features, cuts, max_conditions)
        rule = rule and _prune(left.where("prune"), rule, least_precision, least_covered)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~_all([c.binned() for c in rule]))
    return DecisionList(rules)


def _grow(cells: DataFrame, features, cuts, max_conditions: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        covered = cells.where(_all([c.binned() for c in rule]))
        pairs = F.array(
            *[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in features]
        )
        counts = (
            covered.select(F.explode(pairs).alias("x"), "p", "n")
            .groupBy("x.f", "x.b")
            .agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
            .collect()
        )
        first = [r for r in counts if r.f == features[0]]
        all_p, all_n = sum(r.p for r in first), sum(r.n for r in first)
        if all_p == 0 or all_n == 0:
            break
        best = (1e-9, None)
        for f in features:
            for k, cut in enumerate(cuts[f]):
                p = sum(r.p for r in counts if r.f == f and r.b > k)
                n = sum(r.n for r in counts if r.f == f and r.b > k)
                above = (_gain(p, n, all_p, all_n), Condition(f, True, cut, k + 1))
                below = (_gain(all_p - p, all_n - n, all_p, all_n), Condition(f, False, cut, k + 1))
                best = max(best, above, below, key=lambda x: x[0])
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(cells: DataFrame, rule, least_precision: float, least_covered: int) -> list[Condition]:
    """The prefix of the rule with the best (p - n) / (p + n) on the pruning part, if good enough."""
    sums = cells.agg(
        *[
            F.coalesce(F.sum(F.when(_all([c.binned() for c in rule[:k]]), F.col(x))), F.lit(0)).alias(f"{x}{k}")
            for k in range(1, len(rule) + 1)
            for x in ("p", "n")
        ]
    ).first()
    worth = [
        ((sums[f"p{k}"] - sums[f"n{k}"]) / max(1, sums[f"p{k}"] + sums[f"n{k}"]), -k)
        for k in range(1, len(rule) + 1)
    ]
    k = -max(worth)[1]
    p, n = sums[f"p{k}"], sums[f"n{k}"]
    return rule[:k] if p >= least_covered and p >= least_precision * (p + n) else []

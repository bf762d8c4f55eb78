"""Stepwise choice of categorical variables for a logistic model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.checks import column
from ..functions.numeric import ratio
from ..sources.shared import write_shared
from .encoding import dummy_columns
from .newton import fit_candidates
from .regression import METRICS, LogitFit, feature_patterns

# Criteria where lower is better as is; the others are scores, negated to be minimised.
MINIMISED = ("bic", "aic")
SCORES = {"gini": "gini_test", "rp": "rp", "auc_pr": "auc_pr"}

HISTORY_SCHEMA = (
    "step int, action string, variable string, selected_vars array<string>, best_score double, "
    + ", ".join(f"{m} double" for m in METRICS)
)


@dataclass(frozen=True)
class Selection:
    history: DataFrame
    best_vars: tuple[str, ...]
    best_model: LogitFit | None


class _Candidates:
    """Fits variable sets on one written table of distinct level combinations."""

    def __init__(self, train, test, target, variables):
        self.features = {v: dummy_columns(train.columns, [v]) for v in variables}
        empty = [v for v, names in self.features.items() if not names]
        if empty:
            raise ValueError(f"no dummy columns for {empty}")
        # One small code per variable (0 = base level) instead of all its dummies as keys.
        coded_train, coded_test = (
            df.select(column(target), *[self._code(v).alias(v) for v in variables]) for df in (train, test)
        )
        self.patterns = write_shared(feature_patterns(coded_train, coded_test, target, list(variables)))
        tests = self.patterns.agg(F.sum("test_1"), F.sum("test_0")).first()
        self.prevalence = (tests[0] or 0) / max(1, (tests[0] or 0) + (tests[1] or 0))
        self.spark = train.sparkSession

    def _code(self, variable):
        # flat, however many levels there are; 0 where no dummy is set
        return F.array_position(F.array(*[column(name).cast("int") for name in self.features[variable]]), 1)

    def fit_all(self, trials: Sequence[tuple[str, ...]], wald: bool = False) -> list[LogitFit]:
        """All fits of a step together: the jobs do not grow with the number of trials."""
        return fit_candidates(self.patterns, self.features, trials, self.prevalence, wald)


def _score(fit: LogitFit, criterion: str) -> float | None:
    if criterion in MINIMISED:
        return fit.metrics[criterion]
    value = fit.metrics[SCORES[criterion]]
    return None if value is None else -value


def stepwise_selection_categorical(
    train: DataFrame,
    test: DataFrame,
    target: str,
    cat_vars: Sequence[str],
    direction: str = "both",
    criterion: str = "bic",
    max_vars: int | None = None,
    threshold_in: float = 0.0005,
    threshold_out: float = 0.0,
    start_vars: Sequence[str] = (),
    report: Callable[[str], None] | None = None,
) -> Selection:
    """Add the best variable, then (direction 'both', more than two selected) drop the worst,
    until nothing improves.

    `train` and `test` are encoded tables with `variable&level` columns and the target. Lower is
    better for aic/bic, compared exactly; gini, rp and auc_pr are taken on the test table and
    must gain more than `threshold_in` to add, or lose less than `threshold_out` to drop. The
    first variable wins a tie. A variable added and dropped in one round ends the search.
    """
    if direction not in ("forward", "both"):
        raise ValueError("direction must be 'forward' or 'both'")
    if criterion not in MINIMISED and criterion not in SCORES:
        raise ValueError(f"criterion must be one of {(*MINIMISED, *SCORES)}")
    say = report or (lambda text: None)
    selected = list(start_vars)
    remaining = [v for v in cat_vars if v not in selected]
    candidates = _Candidates(train, test, target, [*selected, *remaining])
    history: list[tuple] = []
    best_score: float | None = None
    best_vars: tuple[str, ...] = ()
    best_fit: LogitFit | None = None

    def best_of(options: list[tuple[str, tuple[str, ...]]]):
        fits = candidates.fit_all([trial for _, trial in options])
        scored = [
            (s, i, variable, fit)
            for i, ((variable, _), fit) in enumerate(zip(options, fits))
            if (s := _score(fit, criterion)) is not None and s == s
        ]
        return min(scored, key=lambda c: c[:2]) if scored else None

    def record(action: str, variable: str, score: float, fit: LogitFit) -> None:
        nonlocal best_score, best_vars, best_fit
        best_score, best_vars, best_fit = score, tuple(selected), fit
        history.append(
            (len(history) + 1, action, variable, list(selected), score, *[fit.metrics[m] for m in METRICS])
        )
        say(f"{action} {variable}: {criterion} {score:.6g} with {selected}")

    while True:
        added = dropped = None
        if remaining:
            found = best_of([(v, (*selected, v)) for v in remaining])
            if found:
                score, _, variable, fit = found
                if best_score is None:
                    better = True
                elif criterion in MINIMISED:
                    better = score < best_score
                else:
                    better = score - best_score < -threshold_in
                if better:
                    selected.append(variable)
                    remaining.remove(variable)
                    record("add", variable, score, fit)
                    added = variable
                    if max_vars is not None and len(selected) >= max_vars:
                        break
        if direction == "both" and len(selected) > 2:
            found = best_of([(v, tuple(s for s in selected if s != v)) for v in selected])
            if found:
                score, _, variable, fit = found
                if best_score is None:  # nothing was accepted yet; no loss can be measured
                    worse = criterion in MINIMISED
                elif criterion in MINIMISED:
                    worse = score < best_score
                else:
                    worse = score - best_score < threshold_out
                if worse:
                    selected.remove(variable)
                    remaining.append(variable)
                    record("remove", variable, score, fit)
                    dropped = variable
        if added is None and dropped is None:
            break
        if added is not None and added == dropped:
            break
        if max_vars is not None and len(selected) >= max_vars:
            break
    # the chosen set again, now with its standard errors
    final = candidates.fit_all([best_vars], wald=True)[0] if best_fit else None
    frame = candidates.spark.createDataFrame(history, HISTORY_SCHEMA)
    return Selection(frame, best_vars, final)


def gini_evolution(history: DataFrame) -> DataFrame:
    """Chart table of a selection history: gini gain in percent and min-max scaled BIC.

    A history has one row per step, so its windows are small.
    """
    before = F.lag("gini_test").over(W.orderBy("step"))
    bounds = history.agg(F.struct(F.min("bic").alias("low"), F.max("bic").alias("high"))).scalar()
    low, high = bounds.getField("low"), bounds.getField("high")
    return history.select(
        "step",
        "gini_train",
        "gini_test",
        "auc_pr",
        "rp",
        "bic",
        F.coalesce(ratio(F.col("bic") - low, high - low), F.lit(0.0)).alias("bic_scaled"),
        ((ratio(F.col("gini_test"), before) - 1) * 100).alias("gini_test_pct_gain"),
    )

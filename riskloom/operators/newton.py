"""Logistic models on level codes: Newton steps for many candidate models at once.

A candidate is a set of variables; its design has one 0/1 column per level but the base. Levels of a
variable exclude each other, so the widest variable's block of the Hessian is diagonal. It is
eliminated in Spark (Schur complement), and the driver solves only the system of the intercept and the
narrower variables; of the widest one it sees a vector. One aggregate an iteration gives the gradients and
Hessians of all candidates, so the number of jobs does not depend on how many there are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import column, require
from ..functions.numeric import ratio
from ..sources.shared import write_shared
from .ordering import running_totals
from .regression import COUNTS, LOG_GUARD, ROWS_PER_TASK, LogitFit, feature_patterns
from .sparse import column_names, design

MAX_STEPS = 60
TOLERANCE = 1e-11  # relative gain of the log-likelihood at which a fit ends


@dataclass(frozen=True)
class Layout:
    """Column numbers of a candidate: 0 the intercept, then its variables, the widest one last."""

    variables: tuple[str, ...]  # as given
    ordered: tuple[str, ...]
    first: dict[str, int]  # column of each variable's code 1
    narrow: int  # columns before the widest variable's
    size: int

    def column_of(self, variable: str, code: int) -> int:
        return self.first[variable] + code - 1


def layout(variables: Sequence[str], levels: Mapping[str, int]) -> Layout:
    """`levels` has the number of levels besides the base of each variable."""
    ordered = tuple(sorted(variables, key=lambda v: (levels[v], variables.index(v))))
    first, at = {}, 1
    for v in ordered:
        first[v] = at
        at += levels[v]
    return Layout(tuple(variables), ordered, first, first[ordered[-1]], at)


def stacked(patterns: DataFrame, layouts: Sequence[Layout]) -> DataFrame:
    """(cand, narrow, cols, counts): the distinct rows of each candidate's variables, written once.

    `patterns` has an int code per variable and the counts by class and role.
    """
    parts = None
    for k, one in enumerate(layouts):
        grouped = patterns.groupBy(*[column(v) for v in one.variables]).agg(*[F.sum(c).alias(c) for c in COUNTS])
        cells = [F.when(column(v) > 0, (column(v) + (one.first[v] - 1)).cast("int")) for v in one.ordered]
        rows = grouped.select(
            F.lit(k).alias("cand"), F.lit(one.narrow).alias("narrow"), F.array_compact(F.array(*cells)).alias("cols"), *COUNTS
        )
        parts = rows if parts is None else parts.unionAll(rows)
    written = write_shared(parts)
    # few rows, few tasks: every iteration is a job over these partitions
    return written.coalesce(max(1, math.ceil(written.count() / ROWS_PER_TASK)))


def _of_candidate(values: Mapping[int, np.ndarray], kind: str = "array<double>") -> Column:
    """The numbers of a row's candidate, as one constant: a number per design column and candidate."""
    text = json.dumps({str(k): v.tolist() for k, v in values.items()})
    return F.try_element_at(F.from_json(F.lit(text), f"map<string,{kind}>"), F.col("cand").cast("string"))


def _probability() -> Column:
    z = F.aggregate("cols", F.get("betas", F.lit(0)), lambda acc, c: acc + F.get(F.col("betas"), c))
    return 1 / (1 + F.exp(-z))


def _cells(rows: DataFrame, betas: Mapping[int, np.ndarray]) -> DataFrame:
    """(cand, narrow, i, j, h, g, ll): Hessian cells i <= j, gradient and log-likelihood on the diagonal."""
    scored = rows.where(F.col("cand").isin(list(betas))).withColumn("betas", _of_candidate(betas))
    p, n = F.col("p"), F.col("train_0") + F.col("train_1")
    active = F.concat(F.array(F.lit(0)), "cols")
    pairs = F.flatten(
        F.transform(
            active,
            lambda i: F.transform(F.filter(active, lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j"))),
        )
    )
    each = scored.withColumn("p", _probability()).select(
        "cand",
        "narrow",
        (n * p * (1 - p)).alias("h"),
        (F.col("train_1") - n * p).alias("g"),
        (F.col("train_1") * F.ln(p + 1e-300) + F.col("train_0") * F.ln(1 - p + 1e-300)).alias("ll"),
        F.explode(pairs).alias("x"),
    )
    diagonal = F.col("x.i") == F.col("x.j")
    return each.groupBy("cand", "narrow", F.col("x.i").alias("i"), F.col("x.j").alias("j")).agg(
        F.sum("h").alias("h"),
        F.sum(F.when(diagonal, F.col("g"))).alias("g"),
        F.sum(F.when(diagonal & (F.col("x.i") == 0), F.col("ll"))).alias("ll"),
    )


def _wide_rows(cells: DataFrame) -> DataFrame:
    """(cand, l, d, gl, x): per column of the widest variable its diagonal, gradient and the cells (i, c) left of it."""
    wide = cells.where("j >= narrow")
    diagonal = F.col("i") == F.col("j")
    return (
        wide.groupBy("cand", F.col("j").alias("l"))
        .agg(
            F.max(F.when(diagonal, F.col("h"))).alias("d"),
            F.max(F.when(diagonal, F.col("g"))).alias("gl"),
            F.collect_list(F.when(~diagonal, F.struct("i", F.col("h").alias("c")))).alias("x"),
        )
        .where("d > 0")
    )


def _reduced(cells: DataFrame) -> DataFrame:
    """(cand, i, j, h, g, gain, ll) of the system without the widest variable, a cell in up to two parts.

    `gain` is that variable's own part of g' H^-1 g, kept at the intercept's cell.
    """
    x = F.col("x")
    pairs = F.flatten(
        F.transform(
            x,
            lambda a: F.transform(
                F.filter(x, lambda b: b["i"] >= a["i"]),
                lambda b: F.struct(
                    a["i"].alias("i"),
                    b["i"].alias("j"),
                    (-a["c"] * b["c"] / F.col("d")).alias("h"),
                    F.when(a["i"] == b["i"], -a["c"] * F.col("gl") / F.col("d")).alias("g"),
                    F.when((a["i"] == 0) & (b["i"] == 0), F.col("gl") * F.col("gl") / F.col("d")).alias("gain"),
                ),
            ),
        )
    )
    none = F.lit(None).cast("double")
    sums = [F.sum(c).alias(c) for c in ("h", "g", "gain")]
    less = _wide_rows(cells).select("cand", F.explode(pairs).alias("y")).select("cand", "y.*").groupBy("cand", "i", "j").agg(*sums)
    rest = cells.where("j < narrow").select("cand", "i", "j", "h", "g", none.alias("gain"), "ll")
    return rest.unionByName(less.withColumn("ll", none))


def _systems(cells: DataFrame, layouts: Sequence[Layout]) -> dict[int, tuple[np.ndarray, np.ndarray, float, float]]:
    """Reduced matrix, reduced gradient, log-likelihood and the widest variable's gain of each candidate."""
    out: dict[int, tuple[np.ndarray, np.ndarray, list[float]]] = {}
    for k, i, j, h, g, gain, ll in _reduced(cells).collect():
        s, grad, totals = out.setdefault(k, (np.zeros((layouts[k].narrow,) * 2), np.zeros(layouts[k].narrow), [0.0, 0.0]))
        s[i, j] += h
        if i == j:
            grad[i] += g
        else:
            s[j, i] += h
        totals[0] += ll or 0.0
        totals[1] += gain or 0.0
    return {k: (s, g, *totals) for k, (s, g, totals) in out.items()}


def _solve(s: np.ndarray, g: np.ndarray) -> np.ndarray:
    if not np.all(np.isfinite(s)):
        raise ArithmeticError("the information matrix is not finite")
    try:
        found = np.linalg.solve(s, g)
        if np.all(np.isfinite(found)) and np.linalg.norm(s @ found - g) <= 1e-6 * (1 + np.linalg.norm(g)):
            return found
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(s, g, rcond=None)[0]  # columns that repeat others: the shortest step


def newton(rows: DataFrame, layouts: Sequence[Layout], start: Sequence[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[int], list[bool]]:
    """Coefficients by column, steps and convergence of each candidate.

    Two jobs an iteration: the reduced systems, and the widest variables' steps. A step that lowered the
    likelihood is halved. A fit ends after a step that promises less than TOLERANCE of the likelihood,
    which also ends fits whose coefficients run to infinity.
    """
    betas = [np.zeros(one.size) for one in layouts] if start is None else [b.copy() for b in start]
    before: list[tuple[float, np.ndarray] | None] = [None] * len(layouts)
    steps, done = [0] * len(layouts), [False] * len(layouts)
    for _ in range(MAX_STEPS):
        open_ = [k for k in range(len(layouts)) if not done[k]]
        if not open_:
            break
        cells = _cells(rows, {k: betas[k] for k in open_})
        moves: dict[int, np.ndarray] = {}
        for k, (s, g, ll, gain) in _systems(cells, layouts).items():
            held = before[k]
            if held is not None and ll < held[0] - 1e-9 * abs(held[0]):
                betas[k] = (betas[k] + held[1]) / 2
                continue
            before[k] = (ll, betas[k].copy())
            moves[k] = _solve(s, g)
            steps[k] += 1
            done[k] = gain + float(g @ moves[k]) <= TOLERANCE * (1 + abs(ll))
        if not moves:
            continue
        # the widest variable's step follows from the others', level by level
        shift = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c["c"] * F.get(F.col("move"), c["i"]))
        wide = _wide_rows(cells.where(F.col("cand").isin(list(moves)))).withColumn("move", _of_candidate(moves))
        for k, l, delta in wide.select("cand", "l", ((F.col("gl") - shift) / F.col("d")).alias("delta")).collect():
            betas[k][l] += delta
        for k, move in moves.items():
            betas[k][: layouts[k].narrow] += move
    return betas, steps, done


def standard_errors(rows: DataFrame, candidate: int, one: Layout, betas: np.ndarray) -> list[float | None]:
    """Wald standard errors of a candidate's columns 1, 2, ... at its coefficients; None where singular.

    The variance of a column of the widest variable is 1/d + c' S^-1 c / d^2 with its row c of the
    Hessian, so only S, the reduced matrix, is inverted on the driver.
    """
    mine = _cells(rows, {candidate: betas})
    s = _systems(mine, {candidate: one})[candidate][0]
    out: list[float | None] = [None] * (one.size - 1)
    if not np.all(np.isfinite(s)) or np.linalg.cond(s) > 1e14:
        return out
    inverse = np.linalg.inv(s)
    form = F.aggregate(
        "x",
        F.lit(0.0),
        lambda acc, a: acc
        + a["c"] * F.aggregate("x", F.lit(0.0), lambda sub, b: sub + b["c"] * F.get(F.get(F.col("inv"), a["i"]), b["i"])),
    )
    wide = _wide_rows(mine).withColumn("inv", _of_candidate({candidate: inverse}, "array<array<double>>"))
    variance = 1 / F.col("d") + form / (F.col("d") * F.col("d"))
    found = {l: v for l, v in wide.select("l", variance).collect()}
    found |= {i: float(inverse[i, i]) for i in range(1, one.narrow)}
    for i, v in found.items():
        out[i - 1] = math.sqrt(v) if v > 0 and math.isfinite(v) else None
    return out


def candidate_metrics(rows: DataFrame, layouts: Sequence[Layout], betas: Sequence[np.ndarray], prevalence: float | None) -> list[dict]:
    """Train and test metrics of all candidates from one ordering of their distinct scores."""
    spark = rows.sparkSession
    given = rows.withColumn("betas", _of_candidate(dict(enumerate(betas))))
    scored = given.select("cand", _probability().alias("p"), *COUNTS)
    by_score = write_shared(scored.groupBy("cand", "p").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    ranked = running_totals(by_score, [F.col("cand").asc(), F.col("p").asc()], COUNTS)
    bases = by_score.groupBy("cand").agg(*[F.sum(c).alias(f"{c}_all") for c in COUNTS])
    # what all earlier candidates hold lies before a candidate's first score; one row per candidate
    sums = {r["cand"]: [r[f"{c}_all"] for c in COUNTS] for r in bases.collect()}
    at, starts = [0] * len(COUNTS), []
    for k in sorted(sums):
        starts.append((k, *sums[k], *at))
        at = [a + b for a, b in zip(at, sums[k])]
    described = "cand int, " + ", ".join([f"{c}_all long" for c in COUNTS] + [f"{c}_start long" for c in COUNTS])
    whole = ranked.join(F.broadcast(spark.createDataFrame(starts, described)), "cand")

    def number(name: str) -> Column:
        return F.col(name).cast("double")

    def before(name: str) -> Column:
        return number(f"{name}_before") - number(f"{name}_start")

    def auc(role: str) -> Column:
        wins = number(f"{role}_1") * (before(f"{role}_0") + number(f"{role}_0") / 2)
        return F.try_divide(F.sum(wins), F.max(number(f"{role}_0_all")) * F.max(number(f"{role}_1_all")))

    p = F.col("p")
    above1, above0 = (number(f"test_{c}_all") - before(f"test_{c}") for c in (1, 0))
    found = whole.groupBy("cand").agg(
        *[F.max(f"{c}_all").alias(c) for c in COUNTS],
        F.sum(number("train_1") * F.ln(p + LOG_GUARD) + number("train_0") * F.ln(1 - p + LOG_GUARD)).alias("loglik"),
        *[F.sum(number(f"{r}_1") * (1 - p) * (1 - p) + number(f"{r}_0") * p * p).alias(f"sq_{r}") for r in ("train", "test")],
        auc("train").alias("auc_train"),
        auc("test").alias("auc_test"),
        F.sum(ratio(F.col("test_1"), F.col("test_1_all")) * ratio(above1, above1 + above0)).alias("ap"),
    )
    out: list[dict] = [{} for _ in layouts]
    for row in found.collect():
        n, m, k = row["train_0"] + row["train_1"], row["test_0"] + row["test_1"], layouts[row["cand"]].size
        common = prevalence if prevalence is not None else (row["test_1"] / m if m else None)
        out[row["cand"]] = {
            "aic": -2 * row["loglik"] + 2 * k,
            "bic": -2 * row["loglik"] + k * math.log(n),
            "gini_train": None if row["auc_train"] is None else 2 * row["auc_train"] - 1,
            "brier_train": row["sq_train"] / n,
            "gini_test": None if row["auc_test"] is None else 2 * row["auc_test"] - 1,
            "auc_pr": row["ap"],
            "rp": row["ap"] / common if row["ap"] is not None and common else None,
            "brier_test": row["sq_test"] / m if m else None,
        }
    return out


def fit_candidates(
    patterns: DataFrame,
    names: Mapping[str, Sequence[str]],
    trials: Sequence[Sequence[str]],
    prevalence: float | None = None,
    wald: bool = False,
) -> list[LogitFit]:
    """Fits of several sets of variables on one table of level codes and counts.

    `names` has the design columns of each variable, code 1 first. Two jobs an iteration and four for
    the metrics serve all trials.
    """
    levels = {v: len(n) for v, n in names.items()}
    layouts = [layout(list(t), levels) for t in trials]
    rows = stacked(patterns, layouts)
    betas, steps, done = newton(rows, layouts)
    metrics = candidate_metrics(rows, layouts, betas, prevalence)
    fits = []
    for k, one in enumerate(layouts):
        places = [one.column_of(v, code) for v in one.variables for code in range(1, levels[v] + 1)]
        errors = standard_errors(rows, k, one, betas[k]) if wald else []
        fits.append(
            LogitFit(
                [name for v in one.variables for name in names[v]],
                float(betas[k][0]),
                [float(betas[k][at]) for at in places],
                metrics[k],
                steps[k],
                done[k],
                [errors[at - 1] for at in places] if wald else [],
            )
        )
    return fits


def fit_by_levels(
    train: DataFrame,
    test: DataFrame,
    target: str,
    variables: Sequence[str],
    prevalence: float | None = None,
    wald: bool = True,
    on_mismatch: str = "error",
) -> LogitFit:
    """Fit the levels of categorical variables of raw tables, without a column per level.

    Levels are ordered by risk on `train`; levels with '#' or the separator count as the base.
    `prevalence` is the test default rate unless given. With on_mismatch 'zero', a level that `train` does not
    have counts as the base too.
    """
    require(train, target, *variables)
    order, *sides = design(train, test, target, variables, on_mismatch=on_mismatch)
    own = order.where("colonne IS NOT NULL")
    first = {r["variable"]: r["low"] for r in own.groupBy("variable").agg(F.min("colonne").alias("low")).collect()}
    names: dict[str, list[str]] = {v: [] for v in variables}
    for r in column_names(order).join(own.select("colonne", "variable"), "colonne").orderBy("colonne").collect():
        names[r["variable"]].append(r["nom"])
    if not all(names.values()):
        raise ValueError(f"only the base level in {[v for v, n in names.items() if not n]}")
    # the design columns of a variable are consecutive
    last = {v: low + len(names[v]) - 1 for v, low in first.items()}

    def code(variable: str) -> Column:
        own = F.filter("colonnes", lambda c: c.between(first[variable], last[variable]))
        return F.coalesce(F.get(own, F.lit(0)) - (first[variable] - 1), F.lit(0)).cast("int").alias(variable)

    coded = [side.select(column(target), *[code(v) for v in variables]) for side in sides]
    patterns = write_shared(feature_patterns(*coded, target, list(variables)))
    return fit_candidates(patterns, names, [tuple(variables)], prevalence, wald)[0]

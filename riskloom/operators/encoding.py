"""Risk-ordered one-hot encoding: columns named `variable&level`, lowest-risk level dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import column, require
from ..functions.numeric import ratio
from .levels import as_level, levels_by_variable

SEPARATOR = "&"


@dataclass(frozen=True)
class Encoding:
    """The encoded table and the level order per variable (first level = base)."""

    frame: DataFrame
    categ: dict[str, list[str]]


def dummy_name(variable: str, level: str) -> str:
    return f"{variable}{SEPARATOR}{level}"


def risk_levels(df: DataFrame, variables: Sequence[str], target: str) -> dict[str, list[str]]:
    """Level order per variable by ascending mean target, from one scan for all variables."""
    rated = levels_by_variable(df, list(variables), target).select(
        "variable", "level", ratio(F.col("nb_defaut"), F.col("n_cible")).alias("taux")
    )
    # the names become columns; `sparse.level_order` keeps an order of any length as a DataFrame
    rows = rated.collect()
    order: dict[str, list[str]] = {v: [] for v in variables}
    for row in sorted(rows, key=lambda r: (r["taux"] is None, r["taux"], r["level"])):
        order[row["variable"]].append(row["level"])
    return order


def _encode(df: DataFrame, categ: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    dummies = [
        F.coalesce((as_level(df, variable) == F.lit(level)).cast("int"), F.lit(0)).alias(dummy_name(variable, level))
        for variable, levels in categ.items()
        for level in levels[1:]
    ]
    return df.select(*[column(k) for k in keep], *dummies)


def get_dummies(
    df: DataFrame,
    target_col: str,
    variables: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
) -> Encoding:
    """Encode every non-target column (or `variables`); `keep` columns, the target unless said
    otherwise, are carried along, since rows have no index to line them up by later."""
    require(df, target_col)
    variables = list(variables) if variables is not None else [c for c in df.columns if c != target_col]
    categ = risk_levels(df, variables, target_col)
    return Encoding(_encode(df, categ, [target_col] if keep is None else keep), categ)


def get_test_dummies(
    df: DataFrame,
    categ: Mapping[str, Sequence[str]],
    keep: Sequence[str] = (),
    on_mismatch: str = "error",
) -> DataFrame:
    """Encode a table with a stored level order.

    'error' requires the same level set as in training, per variable; 'zero' encodes unseen
    levels as all zeros.
    """
    if on_mismatch not in ("error", "zero"):
        raise ValueError("on_mismatch must be 'error' or 'zero'")
    require(df, *categ, *keep)
    if on_mismatch == "error":
        wrong = level_mismatches(df, categ).collect()  # no more than levels
        if wrong:
            raise ValueError(f"{len(wrong)} levels differ from training, among them {sorted(tuple(r) for r in wrong)[:20]}")
    return _encode(df, categ, keep)


def level_mismatches(df: DataFrame, categ: Mapping[str, Sequence[str]]) -> DataFrame:
    """(variable, level, presence) of levels found only in the table or only in training."""
    variables = list(categ)
    values = df.select(*[as_level(df, v).alias(v) for v in variables])
    seen = values.unpivot([], [column(v) for v in variables], "variable", "level").distinct()
    known = df.sparkSession.createDataFrame(
        [(v, level) for v, levels in categ.items() for level in levels], "variable string, level string"
    )
    new = seen.join(known, ["variable", "level"], "left_anti").withColumn("presence", F.lit("nouveau"))
    gone = known.join(seen, ["variable", "level"], "left_anti").withColumn("presence", F.lit("absent"))
    return new.unionByName(gone)


def dummy_columns(names: Sequence[str], variables: Sequence[str]) -> list[str]:
    """Dummy columns of some variables; levels holding '#' or the separator are left out."""
    chosen = []
    for variable in variables:
        prefix = variable + SEPARATOR
        for name in names:
            level = name[len(prefix) :]
            if name.startswith(prefix) and "#" not in level and SEPARATOR not in level:
                chosen.append(name)
    return chosen


def build_dummies(
    train: DataFrame, test: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The same dummy columns of both tables, plus the `keep` columns."""
    names = [column(c) for c in (*keep, *dummy_columns(train.columns, variables))]
    return train.select(*names), test.select(*names)

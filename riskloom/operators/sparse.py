"""Sparse risk-ordered encoding: integer codes per variable and one list of active columns per row.

The level order is a DataFrame, so a variable may have any number of levels: nothing is collected
and no column is made per level. Code 0 is the base, the level with the lowest risk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import column, require
from ..sources.shared import write_shared
from .encoding import SEPARATOR
from .levels import as_level, risk_order
from .ordering import running_totals

#: Columns of a level order.
ORDER = ["variable", "level", "code", "colonne"]


def level_order(df: DataFrame, variables: Sequence[str], target: str) -> DataFrame:
    """(variable, level, code, colonne) by ascending mean target, written once.

    `code` is the rank within the variable, 0 for the base; `colonne` numbers the design columns of all
    variables from 1 on, in the order of variable and code. Levels that hold '#' or the separator are
    ranked but have no design column (NULL), as in `dummy_columns`; neither has the base.
    """
    ranked = risk_order(df, list(variables), target)
    named = ~F.contains("level", F.lit("#")) & ~F.contains("level", F.lit(SEPARATOR))
    rows = ranked.select(
        "variable", "level", F.col("rang").alias("code"), ((F.col("rang") > 0) & named).cast("long").alias("own")
    )
    numbered = running_totals(write_shared(rows), [F.col("variable").asc(), F.col("code").asc()], ["own"])
    number = F.when(F.col("own") == 1, F.col("own_before") + 1)
    return write_shared(numbered.select("variable", "level", "code", number.alias("colonne")))


def unknown_levels(df: DataFrame, order: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, level, presence, effectif) of levels found only in the table or only in the order."""
    seen = (
        df.select(*[as_level(df, v).alias(v) for v in variables])
        .unpivot([], [column(v) for v in variables], "variable", "level")
        .groupBy("variable", "level")
        .agg(F.count(F.lit(1)).alias("effectif"))
    )
    both = seen.join(order.select("variable", "level", "code"), ["variable", "level"], "full")
    presence = F.when(F.col("code").isNull(), "nouveau").when(F.col("effectif").isNull(), "absent")
    return both.select("variable", "level", presence.alias("presence"), F.coalesce("effectif", F.lit(0)).alias("effectif")).where(
        "presence IS NOT NULL"
    )


def encode_levels(
    df: DataFrame,
    order: DataFrame,
    variables: Sequence[str],
    keep: Sequence[str] = (),
    on_mismatch: str = "error",
) -> DataFrame:
    """The `keep` columns, one int code per variable, and `colonnes`, the ascending active design columns.

    'error' asks for the same levels as in `order` and says how many differ; 'zero' gives a level that the
    order does not know the code NULL and no column. Levels are joined variable by variable; a side is
    broadcast only if Spark finds it small, and a frequent level is split by adaptive execution.
    """
    if on_mismatch not in ("error", "zero"):
        raise ValueError("on_mismatch must be 'error' or 'zero'")
    require(df, *variables, *keep)
    clash = {*variables} & {*keep}
    if clash:
        raise ValueError(f"{sorted(clash)} are encoded and kept")
    if on_mismatch == "error":
        wrong = write_shared(unknown_levels(df, order, variables))
        count = wrong.count()
        if count:
            some = [tuple(r) for r in wrong.orderBy("variable", "level").limit(20).collect()]
            raise ValueError(f"{count} levels differ from the order, among them {some}")
    rows = df.select(*[column(k) for k in keep], *[as_level(df, v).alias(f"_level_{i}") for i, v in enumerate(variables)])
    for i, v in enumerate(variables):
        known = order.where(F.col("variable") == v).select(
            F.col("level").alias(f"_level_{i}"), F.col("code").alias(f"_code_{i}"), F.col("colonne").alias(f"_column_{i}")
        )
        rows = rows.join(known, f"_level_{i}", "left")
    columns = F.array_sort(F.array_compact(F.array(*[F.col(f"_column_{i}") for i in range(len(variables))])))
    return rows.select(
        *[column(k) for k in keep], *[F.col(f"_code_{i}").alias(v) for i, v in enumerate(variables)], columns.alias("colonnes")
    )


def column_names(order: DataFrame) -> DataFrame:
    """(colonne, nom) of the design columns, named `variable&level`."""
    return order.where("colonne IS NOT NULL").select(
        "colonne", F.concat("variable", F.lit(SEPARATOR), "level").alias("nom")
    )


def design(
    train: DataFrame, test: DataFrame, target: str, variables: Sequence[str], keep: Sequence[str] = (), on_mismatch: str = "error"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The order learned on `train`, and both tables encoded with it, the target carried along."""
    order = level_order(train, variables, target)
    kept = [target, *[k for k in keep if k != target]]
    return order, encode_levels(train, order, variables, kept, on_mismatch), encode_levels(test, order, variables, kept, on_mismatch)


def as_vectors(encoded: DataFrame, size: int, name: str = "features", columns: str = "colonnes") -> DataFrame:
    """Spark ML sparse vectors of `size` entries, 1 at each active column, for its estimators."""
    from pyspark.ml.feature import CountVectorizerModel

    words = encoded.withColumn("_words", F.transform(column(columns), lambda c: c.cast("string")))
    model = CountVectorizerModel.from_vocabulary([str(k) for k in range(1, size + 1)], "_words", name, minTF=0.0)
    return model.setBinary(True).transform(words).drop("_words")


def dictionary(order: DataFrame, variables: Sequence[str]) -> Mapping[str, list[str]]:
    """The order as lists per variable, base first: for variables whose levels fit the driver."""
    rows = order.where(F.col("variable").isin(list(variables))).orderBy("variable", "code").collect()
    return {v: [r["level"] for r in rows if r["variable"] == v] for v in variables}

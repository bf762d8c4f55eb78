"""Column lookups by name, validated when the plan is built rather than when it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, *names: str | None) -> None:
    absent = [name for name in names if name is not None and name not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}; it has {df.columns}")


def require_numeric(df: DataFrame, name: str) -> None:
    require(df, name)
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.NumericType, T.BooleanType)):
        raise ValueError(f"column {name!r} must be numeric, not {kind.simpleString()}")


def column(name: str) -> Column:
    """Column by exact name; back-ticks keep dots and percent signs literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> Column:
    """True for NULL and, in floating columns, for NaN."""
    value = column(name)
    return value.isNull() | F.isnan(value) if is_floating(df, name) else value.isNull()


def present(df: DataFrame, name: str) -> Column:
    value = column(name)
    return value.isNotNull() & ~F.isnan(value) if is_floating(df, name) else value.isNotNull()


def nan_to_null(df: DataFrame, name: str) -> Column:
    value = column(name)
    if not is_floating(df, name):
        return value
    return F.when(~F.isnan(value), value)


def binary(df: DataFrame, name: str) -> Column:
    """The 0/1 target as int, with NaN as NULL."""
    require_numeric(df, name)
    return nan_to_null(df, name).cast("int")

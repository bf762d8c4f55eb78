"""Row and value clean-up on lazy tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import column, present, require


def impute_missing_values(df: DataFrame, columns: Sequence[str], fill_value: Any) -> DataFrame:
    """Replace NULL (not NaN) by a constant in the given columns, all in one projection.

    A column of whole numbers filled with a fraction becomes double, one filled with a number
    beyond its range bigint; otherwise the constant takes the column's type, and one that cannot
    be cast is an error. `na.fill` would skip such columns without a word and would fill NaN too.
    """
    require(df, *columns)
    return df.withColumns(
        {
            name: _filled(column(name), df.schema[name].dataType, fill_value) for name in columns
        }
    )


def _filled(value: Column, kind: T.DataType, fill_value: Any) -> Column:
    if isinstance(kind, T.IntegralType):
        if isinstance(fill_value, float):
            kind = T.DoubleType()
        elif isinstance(fill_value, int) and not -(2**31) <= fill_value < 2**31:
            kind = T.LongType()
    return F.coalesce(value.cast(kind), F.lit(fill_value).cast(kind))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project to some columns and drop rows where any of them is NULL or NaN."""
    require(df, *columns)
    return df.select(*[column(name) for name in columns]).na.drop()


def where_present(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows where each column is neither NULL nor NaN."""
    require(df, *columns)
    for name in columns:
        df = df.where(present(df, name))
    return df

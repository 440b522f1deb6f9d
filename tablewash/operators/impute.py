"""Filling NULLs of numeric columns. ``fit_*`` reads the data once, ``apply_fill`` is a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import order_statistics
from ..types import InvalidValueError, half_up, number, require_numeric, stored


def fit_mean(df: DataFrame, column: str) -> dict:
    require_numeric(df, column)
    return {"value": _plain(df.agg(F.avg(number(df, column))).first()[0])}


def fit_median(df: DataFrame, column: str) -> dict:
    """The exact median; the mean of the two middle values when their number is even."""
    require_numeric(df, column)
    total, middle = order_statistics(df, column, lambda n: [(n - 1) // 2, n // 2])
    if not total:
        return {"value": None}
    low, high = (_plain(middle[i]) for i in ((total - 1) // 2, total // 2))
    return {"value": low if low == high else (low + high) / 2}


def apply_fill(df: DataFrame, column: str, params: dict) -> DataFrame:
    """Put ``params['value']`` in place of NULL and NaN; integer columns take the rounded value."""
    kind = require_numeric(df, column)
    if params["value"] is None:
        return df
    return df.withColumn(column, F.coalesce(number(df, column), F.lit(half_up(params["value"], kind)).cast(kind)))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return apply_fill(df, column, fit_mean(df, column))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    return apply_fill(df, column, fit_median(df, column))


def fill_value(df: DataFrame, column: str, value) -> DataFrame:
    kind = require_numeric(df, column)
    if value is None:
        raise InvalidValueError("a value is needed to fill with")
    return df.withColumn(column, F.coalesce(number(df, column), stored(kind, value)))


def _plain(value):
    return value if value is None or isinstance(value, (int, float)) else float(value)

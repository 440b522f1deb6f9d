"""Deleting, selecting, inserting and updating rows; replacing outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import all_equal, holds, predicate
from ..types import InvalidValueError, col, compared, require_numeric, stored, type_of


def delete_rows_where(df: DataFrame, clauses: Sequence) -> DataFrame:
    """Delete rows that satisfy the clause list; rows where it is unknown stay."""
    return df.where(~holds(predicate(df, clauses)))


def select_where(df: DataFrame, values: Mapping | None = None) -> DataFrame:
    """Rows whose columns equal all given values."""
    return df.where(all_equal(df, values or {}))


def delete_where(df: DataFrame, values: Mapping | None = None) -> DataFrame:
    """Delete the rows ``select_where`` returns; without values these are all rows."""
    return df.where(~holds(all_equal(df, values or {})))


def insert_row(df: DataFrame, values: Mapping) -> DataFrame:
    """Append one row; columns that are not given become NULL."""
    unknown = set(values) - set(df.columns)
    if unknown or not values:
        raise InvalidValueError(f"a row needs values of existing columns, not of {sorted(unknown)}")
    one = df.sparkSession.range(1).select(
        *[stored(df.schema[c].dataType, values.get(c)).alias(c) for c in df.columns])
    return df.unionByName(one)


def update_where(df: DataFrame, values: Mapping, new_values: Mapping) -> DataFrame:
    """Set columns in the rows that equal all given values."""
    if not values or not new_values:
        raise InvalidValueError("an update needs both a condition and new values")
    hit = holds(all_equal(df, values))
    return df.withColumns({c: F.when(hit, stored(type_of(df, c), v)).otherwise(col(c))
                           for c, v in new_values.items()})


def replace_outliers(df: DataFrame, column: str, larger: bool, value, replacement) -> DataFrame:
    """Replace numbers strictly above (``larger``) or below ``value``."""
    kind = require_numeric(df, column)
    limit = compared(kind, value)
    beyond = col(column) > limit if larger else col(column) < limit
    return df.withColumn(column, F.when(beyond, stored(kind, replacement)).otherwise(col(column)))

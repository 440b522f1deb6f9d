"""Find and replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import java_regex
from ..types import InvalidValueError, col, compared, require_string, stored, type_of


def find_and_replace(df: DataFrame, column: str, value, replacement, exact: bool = True,
                     replace_all: bool = True) -> DataFrame:
    """Replace cells equal to ``value`` (exact), cells holding it, or only its occurrences in them.

    Not exact: substrings are letters and digits only and matched with their case; ``replace_all``
    replaces the whole cell, else each occurrence is replaced in place. Exact matching without
    ``replace_all`` changes nothing.
    """
    kind = type_of(df, column)
    if exact:
        if not replace_all:
            return df
        found = col(column) == compared(kind, value)
        return df.withColumn(column, F.when(found, stored(kind, replacement)).otherwise(col(column)))
    if not str(value).isalnum():
        raise InvalidValueError("substring matching needs a value of letters and digits only")
    require_string(df, column)
    if replace_all:
        changed = F.when(col(column).contains(str(value)), F.lit(str(replacement))).otherwise(col(column))
    else:
        changed = F.replace(col(column), F.lit(str(value)), F.lit(str(replacement)))
    return df.withColumn(column, changed)


def regex_find_and_replace(df: DataFrame, column: str, regex: str, replacement: str,
                           case_sensitive: bool = False) -> DataFrame:
    """Replace every cell in which the regular expression matches anywhere."""
    require_string(df, column)
    pattern = java_regex(df.sparkSession, regex, case_sensitive)
    return df.withColumn(column, F.when(col(column).rlike(pattern), F.lit(str(replacement))).otherwise(col(column)))

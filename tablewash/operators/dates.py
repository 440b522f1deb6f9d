"""Parts of dates as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..naming import unique_name
from ..types import InvalidValueError, col, is_date, require_date, type_of

# The parts that can be extracted.
YEAR = "YEAR"
MONTH_YEAR = "MONTH + YEAR"
MONTH = "MONTH"
WEEKDAY = "DAY OF THE WEEK"
PARTS = [YEAR, MONTH_YEAR, MONTH, WEEKDAY]


def extraction_options(df: DataFrame, column: str) -> list[str]:
    return list(PARTS) if is_date(type_of(df, column)) else []


def extract_date_part(df: DataFrame, column: str, part: str) -> DataFrame:
    """Append the text column ``<column>_part``; a NULL date gives '' for month and year together."""
    require_date(df, column)
    if part not in PARTS:
        raise InvalidValueError(f"{part!r} is none of {PARTS}")
    day = F.to_date(col(column))
    year, month = F.year(day).cast("string"), F.date_format(day, "MMMM")
    value = {
        YEAR: year,
        MONTH_YEAR: F.concat_ws(" ", month, year),
        MONTH: month,
        WEEKDAY: F.date_format(day, "EEEE"),
    }[part]
    return df.withColumn(unique_name(df.columns, f"{column}_part"), value)

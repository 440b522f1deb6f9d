"""Dropping, renaming and converting columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import DATE_FORMATS, datetime_pattern
from ..functions.text import float_text
from ..naming import unique_name
from ..types import (LENGTH_KEY, ConversionError, InvalidValueError, col, is_date, is_integer, is_numeric, is_string,
                     require_string, type_of)

# The target types offered for each class of column.
CONVERSIONS = {
    "string": ["INTEGER", "FLOAT", "DATE", "TIME", "TIMESTAMP", "VARCHAR(255)", "VARCHAR(n)", "CHAR(n)"],
    "integer": ["FLOAT", "VARCHAR(255)", "VARCHAR(n)", "CHAR(n)"],
    "float": ["INTEGER", "VARCHAR(255)", "VARCHAR(n)", "CHAR(n)"],
    "date": ["VARCHAR(255)", "VARCHAR(n)", "CHAR(n)"],
    "other": ["VARCHAR(255)"],
}

# What text must look like to be converted by force, in the strict reading.
FORCE_PATTERNS = {
    "INTEGER": r"^[-+]?[0-9]+$",
    "FLOAT": r"^[-+.]?[0-9]+[.]?[e]?[-+]?[0-9]*$",
}

# Decimal and exponent notation, or one of the special values; nothing with a type suffix.
FLOAT_TEXT = r"(?i)^\s*[-+]?((\d+\.?\d*|\.\d+)(e[-+]?\d+)?|inf|infinity|nan)\s*$"
SIZED = ("VARCHAR(n)", "CHAR(n)")


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """Without the column; unknown names are ignored."""
    return df.drop(column)


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    """Rename, numbering the new name when the table already uses it."""
    type_of(df, column)
    others = [c for c in df.columns if c != column or c == new_name]
    return df.withColumnRenamed(column, unique_name(others, new_name))


def nullify_empty(df: DataFrame, column: str) -> DataFrame:
    """Empty strings become NULL."""
    require_string(df, column)
    return df.withColumn(column, F.nullif(col(column), F.lit("")))


def conversion_options(df: DataFrame, column: str) -> list[str]:
    return CONVERSIONS[_type_class(type_of(df, column))]


def date_formats(to_type: str) -> list[str]:
    return DATE_FORMATS.get(to_type, [])


def convert(df: DataFrame, column: str, to_type: str, data_format: str = "", length: int | None = None,
            validate: bool = True) -> DataFrame:
    """Strict conversion: one value that cannot be converted fails the whole operation.

    With ``validate`` one aggregate over the column counts such values first and names them in
    the error. Without it there is no extra pass and the running job fails instead.
    """
    converted, good = _conversion(df, column, to_type, data_format, length)
    if validate:
        bad = df.agg(F.count_if(~good)).first()[0]
        if bad:
            raise ConversionError(f'{bad} values of column "{column}" cannot be converted to {to_type}'
                                  + (f" of length {length}" if to_type in SIZED else ""))
    else:
        failure = F.raise_error(F.concat(F.lit(f'cannot convert value of column "{column}" to {to_type}: '),
                                         col(column).cast("string")))
        converted = F.when(good, converted).otherwise(failure.cast(_result_type(to_type)))
    return _replaced(df, column, converted, to_type, length)


def force_convert(df: DataFrame, column: str, to_type: str, data_format: str = "", length: int | None = None,
                  mode: str = "SET_NULL", compat_regex: bool = False, validate: bool = True) -> DataFrame:
    """Conversion of text that turns bad values into NULL, or deletes their rows.

    Other columns than text are converted strictly, with or without a look at the data first (``validate``). ``compat_regex`` decides by the shape of
    the text alone, which refuses some valid numbers, instead of by the conversion itself.
    """
    if mode not in ("SET_NULL", "DELETE_ROW"):
        raise InvalidValueError("mode is SET_NULL or DELETE_ROW")
    if not is_string(type_of(df, column)):
        return convert(df, column, to_type, data_format, length, validate)
    raw = col(column)
    converted, good = _conversion(df, column, to_type, data_format, length)
    if to_type in ("INTEGER", "FLOAT", "DATE", "TIME", "TIMESTAMP"):
        good = good & (raw != "")
        if compat_regex:
            good = good & raw.rlike(_shape(to_type, data_format))
    elif length is not None:
        good = F.length(raw) <= length
    if mode == "DELETE_ROW":
        df = df.where(raw.isNull() | good)
    return _replaced(df, column, F.when(good, converted), to_type, length)


def _type_class(kind: T.DataType) -> str:
    if is_string(kind):
        return "string"
    if is_integer(kind):
        return "integer"
    if is_numeric(kind):
        return "float"
    return "date" if is_date(kind) else "other"


def _result_type(to_type: str) -> str:
    return {"INTEGER": "int", "FLOAT": "double", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}.get(to_type, "string")


def _conversion(df: DataFrame, column: str, to_type: str, data_format: str, length: int | None
                ) -> tuple[Column, Column]:
    """The converted value (NULL where impossible) and a test that is true for NULL and for good values."""
    kind = type_of(df, column)
    if to_type not in CONVERSIONS[_type_class(kind)]:
        raise InvalidValueError(f"{kind.simpleString()} columns cannot be converted to {to_type}")
    if to_type in DATE_FORMATS and data_format not in DATE_FORMATS[to_type]:
        raise InvalidValueError(f"{data_format!r} is no format for {to_type}")
    if to_type in SIZED and length is None and not is_string(kind):
        raise InvalidValueError(f"{to_type} needs a length")
    raw = col(column)
    if is_string(kind):
        converted, empty_is_null = _from_text(raw, to_type, data_format, length)
        raw = F.nullif(raw, F.lit("")) if empty_is_null else raw
    else:
        converted = _from_typed(raw, kind, to_type)
    if to_type in SIZED and length is not None:
        return converted, converted.isNull() | (F.length(converted) <= length)
    return converted, raw.isNull() | converted.isNotNull()


def _from_text(raw: Column, to_type: str, data_format: str, length: int | None) -> tuple[Column, bool]:
    if to_type in SIZED and length is not None:
        return raw, False
    text = F.nullif(raw, F.lit(""))
    pattern = datetime_pattern(data_format)
    if to_type == "INTEGER":
        return text.try_cast("int"), True
    if to_type == "FLOAT":
        return F.when(text.rlike(FLOAT_TEXT), text.try_cast("double")), True
    if to_type == "DATE":
        return F.try_to_date(text, pattern), True
    if to_type == "TIME":
        return F.date_format(F.try_to_timestamp(text, F.lit(pattern)), "HH:mm:ss"), True
    if to_type == "TIMESTAMP":
        return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"), True
    return text, True


def _from_typed(raw: Column, kind: T.DataType, to_type: str) -> Column:
    if to_type == "INTEGER":
        return F.rint(raw.cast("double")).try_cast("int")
    if to_type == "FLOAT":
        return raw.cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float_text(raw)
    return raw.cast("string")


def _shape(to_type: str, data_format: str) -> str:
    if to_type in FORCE_PATTERNS:
        return FORCE_PATTERNS[to_type]
    date_part = data_format.replace(" TIME", "")
    return re.sub("YYYY", "[0-9]{4}", re.sub("DD|MM|HH24|HH12|MI|SS", "[0-9]{1,2}", date_part)).replace("AM/PM", "")


def _replaced(df: DataFrame, column: str, converted: Column, to_type: str, length: int | None) -> DataFrame:
    metadata = {LENGTH_KEY: length} if to_type in SIZED and length is not None else {}
    return df.withColumn(column, converted.alias(column, metadata=metadata))

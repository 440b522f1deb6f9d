"""Type classes, SQL type names, literals of a column's type, and the error classes."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CleaningError(Exception):
    """Base of all errors raised by this package."""


class AttrTypeError(CleaningError):
    """The operator does not support the type of this column."""


class InvalidValueError(CleaningError):
    """A parameter or value cannot be used in this operation."""


class ConversionError(InvalidValueError):
    """Some values cannot be converted to the requested type."""


class TypeMismatchError(CleaningError):
    """Join columns have different types."""


class ColumnNameClashError(CleaningError):
    """Tables to be joined share column names."""


class NoJoinColumnsError(CleaningError):
    """Tables to be joined naturally share no column name."""


class EmptyFileError(CleaningError):
    """The input file has no content."""


class InvalidFileExtensionError(CleaningError):
    """The file extension belongs to no known format."""


class ColumnInconsistencyError(CleaningError):
    """Rows of a CSV file differ in their number of columns."""


class DumpInconsistencyError(CleaningError):
    """A statement of an SQL dump cannot be understood."""


class NoTablesInDumpError(CleaningError):
    """An SQL dump creates no table."""


INTEGERS = (T.ShortType, T.IntegerType, T.LongType)
NUMBERS = INTEGERS + (T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
STRINGS = (T.StringType, T.CharType, T.VarcharType)

# Key of the column metadata that keeps the length of VARCHAR(n) / CHAR(n).
LENGTH_KEY = "max_length"

# SQL names of the types.
SQL_NAMES = {
    T.StringType: "VARCHAR", T.VarcharType: "VARCHAR", T.CharType: "CHAR",
    T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
    T.FloatType: "REAL", T.DoubleType: "FLOAT", T.DecimalType: "NUMERIC",
    T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMPTZ",
    T.BooleanType: "BOOLEAN",
}


def is_integer(data_type: T.DataType) -> bool:
    return isinstance(data_type, INTEGERS)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, NUMBERS)


def is_date(data_type: T.DataType) -> bool:
    return isinstance(data_type, DATES)


def is_string(data_type: T.DataType) -> bool:
    return isinstance(data_type, STRINGS)


def type_of(df: DataFrame, column: str) -> T.DataType:
    if column not in df.columns:
        raise InvalidValueError(f'there is no column "{column}"')
    return df.schema[column].dataType


def require_numeric(df: DataFrame, column: str) -> T.DataType:
    found = type_of(df, column)
    if not is_numeric(found):
        raise AttrTypeError(f'column "{column}" is {found.simpleString()}, a numeric type is needed')
    return found


def require_string(df: DataFrame, column: str) -> T.DataType:
    found = type_of(df, column)
    if not is_string(found):
        raise AttrTypeError(f'column "{column}" is {found.simpleString()}, a character type is needed')
    return found


def require_date(df: DataFrame, column: str) -> T.DataType:
    found = type_of(df, column)
    if not is_date(found):
        raise AttrTypeError(f'column "{column}" is {found.simpleString()}, a date type is needed')
    return found


def sql_name(field: T.StructField) -> str:
    """SQL name of a column's type, with its length limit if there is one."""
    name = SQL_NAMES.get(type(field.dataType), field.dataType.simpleString().upper())
    length = (field.metadata or {}).get(LENGTH_KEY) or getattr(field.dataType, "length", None)
    if is_string(field.dataType) and length:
        return f"{name}({length})"
    if isinstance(field.dataType, T.DecimalType):
        return f"{name}({field.dataType.precision},{field.dataType.scale})"
    return name


def column_types(df: DataFrame) -> dict[str, str]:
    return {field.name: sql_name(field) for field in df.schema.fields}


def col(name: str) -> Column:
    """Column by its plain name, also when the name holds dots or other signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(df: DataFrame, column: str) -> Column:
    """The numeric column with NaN read as NULL."""
    if isinstance(type_of(df, column), (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(column)), col(column))
    return col(column)


def is_number(df: DataFrame, column: str) -> Column:
    """Neither NULL nor NaN."""
    if isinstance(type_of(df, column), (T.FloatType, T.DoubleType)):
        return col(column).isNotNull() & ~F.isnan(col(column))
    return col(column).isNotNull()


def python_value(data_type: T.DataType, value):
    """``value`` (often text from a form) as a Python value of the column's type."""
    if value is None:
        return None
    try:
        if is_string(data_type):
            return str(value)
        if isinstance(data_type, T.BooleanType):
            if isinstance(value, bool):
                return value
            return {"true": True, "t": True, "false": False, "f": False}[str(value).strip().lower()]
        if isinstance(data_type, T.DecimalType) or (is_integer(data_type) and not isinstance(value, int)):
            return Decimal(str(value).strip())
        if is_integer(data_type):
            return int(value)
        if is_numeric(data_type):
            return float(value)
        if isinstance(data_type, T.DateType):
            return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value).strip())
        if is_date(data_type):
            return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).strip())
    except (ValueError, KeyError, InvalidOperation):
        raise InvalidValueError(f"{value!r} is no valid {data_type.simpleString()} value") from None
    raise InvalidValueError(f"values of type {data_type.simpleString()} cannot be given as parameters")


def half_up(value, data_type: T.DataType):
    """A fitted or given number as the column stores it: integers round half away from zero."""
    if value is None:
        return None
    if is_integer(data_type):
        whole = abs(Decimal(str(value))).quantize(Decimal(1), rounding="ROUND_HALF_UP")
        return int(whole if float(value) >= 0 else -whole)
    if isinstance(data_type, T.DecimalType):
        return Decimal(str(value))
    return float(value)


def stored(data_type: T.DataType, value) -> Column:
    """Literal to be written into a column of this type."""
    plain = python_value(data_type, value)
    if is_numeric(data_type):
        plain = half_up(plain, data_type)
    return F.lit(plain).cast(data_type)


def compared(data_type: T.DataType, value) -> Column:
    """Literal to be compared with a column of this type; 2.5 stays 2.5 beside integers."""
    return F.lit(python_value(data_type, value))

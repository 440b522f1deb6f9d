"""Row predicates built from lists of clauses or from column values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import InvalidValueError, col, compared, type_of

OPERATORS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}

# The spelling by which a form asks for NULL.
NULL_WORD = '"null"'


def clause(df: DataFrame, column: str, operator: str, value) -> Column:
    kind = type_of(df, column)
    if operator not in OPERATORS:
        raise InvalidValueError(f"unknown comparison {operator!r}")
    if value is None or value == NULL_WORD:
        if operator == "=":
            return col(column).isNull()
        if operator in ("!=", "<>"):
            return col(column).isNotNull()
        raise InvalidValueError(f"NULL cannot be compared with {operator!r}")
    return OPERATORS[operator](col(column), compared(kind, value))


def predicate(df: DataFrame, clauses: Sequence) -> Column:
    """Predicate of ``[column, op, value, 'AND' | 'OR', column, op, value, ...]``; AND binds tighter."""
    if len(clauses) < 3 or (len(clauses) - 3) % 4:
        raise InvalidValueError("a predicate is made of (column, operator, value) joined by AND / OR")
    alternatives: list[list[Column]] = [[]]
    for start in range(0, len(clauses), 4):
        if start:
            link = str(clauses[start - 1]).upper()
            if link not in ("AND", "OR"):
                raise InvalidValueError(f"clauses are joined by AND or OR, not by {link!r}")
            if link == "OR":
                alternatives.append([])
        alternatives[-1].append(clause(df, *clauses[start:start + 3]))
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, group) for group in alternatives])


def all_equal(df: DataFrame, values: Mapping) -> Column:
    """Conjunction of equalities; true for every row when no column is named."""
    return reduce(lambda a, b: a & b,
                  [col(name) == compared(type_of(df, name), value) for name, value in values.items()],
                  F.lit(True))


def holds(condition: Column) -> Column:
    """Two-valued form of a predicate: NULL counts as not satisfied."""
    return F.coalesce(condition, F.lit(False))

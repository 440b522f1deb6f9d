"""Discretisation: edges are fitted or given, the assignment is one expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import order_statistics
from ..functions.trees import interval_label
from ..naming import unique_name
from ..types import InvalidValueError, is_integer, number, require_numeric

MIN_BINS, MAX_BINS = 2, 20
# Below this maximum, fractional columns are taken for shares of one.
SHARE_LIMIT = 2


def fit_equal_width(df: DataFrame, column: str, bins: int) -> dict:
    """Edges of ``bins`` equally wide bins, to three decimals; whole numbers for integer columns."""
    kind = require_numeric(df, column)
    if int(bins) < 1:
        raise InvalidValueError("at least one bin is needed")
    value = number(df, column)
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        raise InvalidValueError(f'column "{column}" holds no number')
    if is_integer(kind):
        # Whole numbers only: the smallest width with which the last edge lies above the maximum.
        low, step = int(low), (int(high) - int(low)) // int(bins) + 1
        return {"edges": [low + i * step for i in range(bins + 1)]}
    if math.isinf(low) or math.isinf(high):
        raise InvalidValueError(f'column "{column}" holds an infinite number')
    left = math.floor(float(low) * 1000) / 1000
    step = round(_width(left, float(high), bins), 3)
    edges = [left]
    for _ in range(bins):
        edges.append(max(float(f"{edges[-1] + step:.3f}"), _above(edges[-1])))
    # Far from zero a thousandth vanishes in rounding; the maximum must lie below the last edge all the same.
    edges[-1] = max(edges[-1], _above(float(high)))
    return {"edges": edges}


def _above(value: float) -> float:
    """The next larger number there is."""
    return math.nextafter(value, math.inf)


def _width(left, high, bins: int) -> float:
    """Width that covers the range up to just above its maximum, rounded up to a thousandth."""
    right = math.ceil((high + 0.0001) * 1000) / 1000
    return math.ceil((right - left) / bins * 1000) / 1000


def fit_equal_frequency(df: DataFrame, column: str) -> dict:
    """Edges that put about equally many values in each of sqrt(n) bins, at least 2 and at most 20."""
    kind = require_numeric(df, column)
    total, values = order_statistics(df, column, _edge_ranks)
    if not total:
        raise InvalidValueError(f'column "{column}" holds no number')
    ranks = _edge_ranks(total)
    numbers = [values[rank] if is_integer(kind) else float(values[rank]) for rank in ranks]
    shares = not isinstance(kind, T.IntegerType) and numbers[-1] < SHARE_LIMIT
    if is_integer(kind):
        upper = [v + 1 for v in numbers[1:]]
    elif any(math.isinf(v) for v in numbers):
        raise InvalidValueError(f'column "{column}" holds an infinite number')
    elif shares:
        upper = [round(v + 0.05, 1) for v in numbers[1:]]
    else:
        upper = [max(math.ceil(v + 0.0001), _above(v)) for v in numbers[1:]]
    return {"edges": sorted({numbers[0], *upper})}


def _edge_ranks(total: int) -> list[int]:
    """Positions of the first value and of the last value of every bin; early bins take the remainder."""
    bins = min(max(math.isqrt(total), MIN_BINS), MAX_BINS)
    size, extra = divmod(total, bins)
    ends = [(i + 1) * size + min(i + 1, extra) - 1 for i in range(bins)]
    return [0] + [max(end, 0) for end in ends]


def apply_bins(df: DataFrame, column: str, params: dict, exclude_right: bool = True) -> DataFrame:
    """Append ``<column>_categorical`` with the label of each value's interval, NULL outside."""
    require_numeric(df, column)
    edges = params["edges"]
    sign = "[" if exclude_right else "]"
    labels = [f"{sign}{low} , {high}{sign}" for low, high in zip(edges, edges[1:])]
    label = interval_label(number(df, column), edges, labels, left_closed=exclude_right)
    return df.withColumn(unique_name(df.columns, f"{column}_categorical"), label)


def bin_equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    return apply_bins(df, column, fit_equal_width(df, column, bins))


def bin_equal_frequency(df: DataFrame, column: str) -> DataFrame:
    return apply_bins(df, column, fit_equal_frequency(df, column))


def bin_custom(df: DataFrame, column: str, edges: Sequence, exclude_right: bool = True) -> DataFrame:
    """Given edges: ``[a , b[``, or ``]a , b]`` when the right end belongs to the interval."""
    edges = list(edges)
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise InvalidValueError("at least two strictly increasing edges are needed")
    return apply_bins(df, column, {"edges": edges}, exclude_right)

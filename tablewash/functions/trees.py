"""Balanced decision trees over sorted edges: log2(n) comparisons per row, all in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_edges(value: Column, edges: Sequence, leaf: Callable[[int], Column], left_closed: bool = True) -> Column:
    """``leaf(g)`` where g counts the edges at or below ``value`` (strictly below if not left closed)."""

    def build(low: int, high: int) -> Column:
        if low == high:
            return leaf(low)
        middle = (low + high) // 2
        edge = F.lit(edges[middle])
        before = value < edge if left_closed else value <= edge
        return F.when(before, build(low, middle)).otherwise(build(middle + 1, high))

    return build(0, len(edges))


def interval_label(value: Column, edges: Sequence, labels: Sequence[str], left_closed: bool = True) -> Column:
    """Label of the interval that holds ``value``; NULL outside all of them and for NULL."""

    def leaf(count: int) -> Column:
        inside = 0 < count < len(edges)
        return F.lit(labels[count - 1]) if inside else F.lit(None).cast("string")

    return F.when(value.isNotNull(), by_edges(value, edges, leaf, left_closed))

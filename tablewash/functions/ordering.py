"""Exact order statistics and neighbours in a global order, without a global sort in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from ..types import col, is_number
from .trees import by_edges

# Ranks of sketched quantiles are off by at most one in this many rows.
ACCURACY = 10_000
# Quantiles that are sketched together with the count, before the wanted ranks are known.
GRID = 500
# Most rows of one value range that are ranked in one task; longer ranges are sketched again.
LEAF_ROWS = 100_000


@dataclass
class _Range:
    """Open value range (low, high) that still holds wanted ranks; ``None`` is unbounded."""

    low: object
    high: object
    before: int
    rows: int
    ranks: list[int]

    def holds(self, value: Column) -> Column:
        tests = [value > F.lit(self.low)] if self.low is not None else []
        tests += [value < F.lit(self.high)] if self.high is not None else []
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def quantiles(self, value: Column) -> Column:
        """Sketched values just below and above each wanted rank."""
        shares = [min(max((rank - self.before) / self.rows + margin / ACCURACY, 0.0), 1.0)
                  for rank in self.ranks for margin in (-1.5, 1.5)]
        bounded = self.low is not None or self.high is not None
        return F.percentile_approx(F.when(self.holds(value), value) if bounded else value, sorted(set(shares)), ACCURACY)


def order_statistics(df: DataFrame, column: str, ranks_for: Callable[[int], Iterable[int]]) -> tuple[int, dict]:
    """Count n of non-null values and the exact values at the 0-based sorted positions ``ranks_for(n)``.

    A sketch of evenly spaced quantiles, taken with the count, proposes pivots close to each rank; one
    counting pass places the ranks between the pivots, and only the narrow ranges left are grouped by
    value and ranked, or sketched again while they are long. Pivots merely steer the search, the counts
    decide. Every pass scans one column and shuffles a few counters or a small part of the values.
    """
    value = F.col("v")
    values = df.where(is_number(df, column)).select(col(column).alias("v"))
    total, grid = values.agg(F.count(value), F.percentile_approx(value, [i / GRID for i in range(GRID + 1)],
                                                                 ACCURACY)).first()
    if not total:
        return 0, {}
    found: dict[int, object] = {}
    ranks = sorted(set(ranks_for(total)))
    if not ranks:
        return total, {}
    margin = 1.5 * GRID / ACCURACY
    places = [(math.floor(GRID * rank / total - margin), math.ceil(GRID * (rank + 1) / total + margin)) for rank in ranks]
    pivots = {grid[min(max(place, 0), GRID)] for pair in places for place in pair}
    leaves: list[_Range] = []
    ranges = _split(values, [_Range(None, None, 0, total, ranks)], pivots, found, leaves)
    while ranges:
        sketches = values.agg(*[r.quantiles(value).alias(f"q{i}") for i, r in enumerate(ranges)]).first()
        pivots = {pivot for sketch in sketches for pivot in sketch}
        ranges = _split(values, ranges, pivots, found, leaves)
    if leaves:
        found.update(_rank_leaves(values, leaves))
    return total, found


def _split(values: DataFrame, ranges: list[_Range], pivots: set, found: dict, leaves: list[_Range]) -> list[_Range]:
    """Place the wanted ranks between counted pivots; returns the ranges that are still too long."""
    value = F.col("v")
    edges = sorted(pivots.union(b for r in ranges for b in (r.low, r.high) if b is not None))

    def place(count: int) -> Column:
        # Odd places hold an edge itself, even places the open range behind it.
        if count == 0:
            return F.lit(0)
        return F.when(value == F.lit(edges[count - 1]), 2 * count - 1).otherwise(2 * count)

    rows = values.groupBy(by_edges(value, edges, place).alias("place")).count().collect()
    sizes = {row["place"]: row["count"] for row in rows}
    open_ranges, start = [], 0
    wanted = sorted(rank for r in ranges for rank in r.ranks)
    longest = max(r.rows for r in ranges)
    for spot in range(2 * len(edges) + 1):
        size = sizes.get(spot, 0)
        inside = [rank for rank in wanted if start <= rank < start + size]
        if inside and spot % 2:
            found.update({rank: edges[spot // 2] for rank in inside})
        elif inside:
            low = edges[spot // 2 - 1] if spot else None
            high = edges[spot // 2] if spot // 2 < len(edges) else None
            piece = _Range(low, high, start, size, inside)
            if size > LEAF_ROWS and size >= longest:
                # Every pivot is a value of its range and leaves it, so that ranges must shrink.
                raise RuntimeError("the values changed between two passes")
            (leaves if size <= LEAF_ROWS else open_ranges).append(piece)
        start += size
    return open_ranges


def _rank_leaves(values: DataFrame, leaves: list[_Range]) -> dict[int, object]:
    value = F.col("v")
    edges = sorted({b for r in leaves for b in (r.low, r.high) if b is not None})
    behind = {r.low: i for i, r in enumerate(leaves)}

    def leaf(count: int) -> Column:
        index = behind.get(edges[count - 1] if count else None)
        return F.lit(-1 if index is None else index)

    inside = reduce(lambda a, b: a | b, [r.holds(value) for r in leaves])
    counts = values.where(inside).groupBy(by_edges(value, edges, leaf).alias("leaf"), "v").count()
    before = F.element_at(F.array(*[F.lit(r.before) for r in leaves]), F.col("leaf") + 1)
    upto = F.sum("count").over(Window.partitionBy("leaf").orderBy("v")) + before
    ranks = F.element_at(F.array(*[F.array(*map(F.lit, r.ranks)) for r in leaves]), F.col("leaf") + 1)
    hits = (counts.withColumn("upto", upto).withColumn("rank", F.explode(ranks))
            .where((F.col("upto") - F.col("count") <= F.col("rank")) & (F.col("rank") < F.col("upto"))))
    return {row["rank"]: row["v"] for row in hits.select("rank", "v").collect()}


def with_neighbours(df: DataFrame, order: str, carry: list[str]) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` of the rows before and after in the order of a unique column.

    Rows are range partitioned and each range is looked at by itself; the first and last row of
    every range (as many as there are partitions) close the gaps between ranges.
    """
    ranged = checkpoint(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    packed = F.struct(*carry)
    ends = (ranged.groupBy("_range").agg(F.min_by(packed, order).alias("first"), F.max_by(packed, order).alias("last"))
            .orderBy("_range").collect())
    kinds = ", ".join(f"{c}: {df.schema[c].dataType.simpleString()}" for c in carry).replace(": ", ":")
    stitches = [(row["_range"],
                 ends[i - 1]["last"] if i else None,
                 ends[i + 1]["first"] if i + 1 < len(ends) else None) for i, row in enumerate(ends)]
    seams = df.sparkSession.createDataFrame(
        stitches, f"_range int, _before struct<{kinds}>, _after struct<{kinds}>")
    window = Window.partitionBy("_range").orderBy(order)
    around = (ranged.withColumn("_lag", F.lag(packed).over(window)).withColumn("_lead", F.lead(packed).over(window))
              .join(seams, "_range", "left")
              .withColumn("_lag", F.coalesce("_lag", "_before")).withColumn("_lead", F.coalesce("_lead", "_after")))
    return around.select(*df.columns,
                         *[F.col(f"_lag.{c}").alias(f"prev_{c}") for c in carry],
                         *[F.col(f"_lead.{c}").alias(f"next_{c}") for c in carry])

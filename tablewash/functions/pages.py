"""Pages of a table in any order, found by selecting ranks instead of sorting or copying the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import col, type_of
from .ordering import order_statistics

# Rows up to which a page is taken from the first rows of every task, and rows with one key that are simply sorted.
NEAR_ROWS = 10_000
# Bytes of a text in one number, which a double still holds.
CHUNK = 6


@dataclass(frozen=True)
class Order:
    """A column to sort by; NULL sorts above every value unless ``nulls_first`` says where it goes."""

    column: str
    ascending: bool = True
    nulls_first: bool | None = None

    def nulls_come_first(self) -> bool:
        return not self.ascending if self.nulls_first is None else self.nulls_first

    def sort(self) -> Column:
        name = ("asc" if self.ascending else "desc") + ("_nulls_first" if self.nulls_come_first() else "_nulls_last")
        return getattr(F, name)(col(self.column))


@dataclass(frozen=True)
class _Level:
    """One number to sort by. An order is a list of levels: NULL or not, the value, or the value piece by piece."""

    key: Column
    ascending: bool = True
    few: bool = False  # so few values that they are counted one by one
    text: Order | None = None  # the text this is a piece of
    piece: int = 0

    def before(self, value) -> Column:
        return self.key < F.lit(value) if self.ascending else self.key > F.lit(value)

    def after(self, value) -> Column:
        return self.key > F.lit(value) if self.ascending else self.key < F.lit(value)


def page_rows(df: DataFrame, orders: Sequence[Order], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order.

    Near the beginning each task keeps its first rows. Further in, the keys of the first and of the last row of the
    page are found by rank, column by column of the order and only as far as needed: a column is
    sketched and counted (``order_statistics``), and within a long run of equal values the next column decides. Only columns
    of the order are read for that, nothing is written, and the rows between the two keys are all that is sorted. Rows
    equal in the whole order come in the order of a hash of all their columns. Columns that cannot be
    ordered by numbers (nested ones, decimals of more than 15 digits) are sorted whole.
    """
    sorts = [order.sort() for order in orders]
    if offset + limit <= NEAR_ROWS or limit < 1:
        return df.orderBy(*sorts).offset(offset).limit(limit)
    levels = [_levels(df, order) for order in orders]
    if any(found is None for found in levels):
        return df.orderBy(*sorts).offset(offset).limit(limit)
    tie = F.xxhash64(*[col(name) for name in df.columns])
    whole = [level for found in levels for level in found]
    whole += [_Level(F.shiftright(tie, 32)), _Level(tie.bitwiseAND(F.lit((1 << 32) - 1)))]
    counts = _counts(df.select(whole[0].key.alias("k")), whole[0])
    total = sum(size for _, size in counts)
    if offset >= total:
        return df.limit(0)
    bounds = [_Bound(rank, list(whole)) for rank in (offset, min(offset + limit, total) - 1)]
    _choose_counted(counts, whole[0], bounds)
    first, last = _find(df, bounds)
    if first.size > NEAR_ROWS:
        # Rows that are equal in every column.
        same = df.where(first.equal())
        inside = first.before + first.size - offset
        if inside >= limit:
            return same.limit(limit)
        rest = df.where(first.after() & last.reached())
        return same.limit(inside).unionByName(rest).orderBy(*sorts, tie).limit(limit)
    return (df.where(first.reached_or_after() & last.reached()).orderBy(*sorts, tie)
            .offset(offset - first.before).limit(limit))


def unsorted_page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order in which the table is read.

    Far from the beginning the rows of every partition are counted, which reads no column, and each task lets
    only those pass that lie on the page; a plain offset would bring all rows before it into one task.
    """
    if offset + limit <= NEAR_ROWS or limit < 1:
        return df.offset(offset).limit(limit)
    at = "_at"
    while at in df.columns:
        at += "_"
    # Numbers of rows in their partition, below the number of the partition.
    placed = df.withColumn(at, F.monotonically_increasing_id())
    before, pages = 0, []
    for part, rows in sorted(map(tuple, placed.groupBy(F.shiftright(at, 33).alias("part")).count().collect())):
        first, last = max(offset - before, 0), min(offset + limit - before, rows)
        if first < last:
            pages.append(F.col(at).between((part << 33) + first, (part << 33) + last - 1))
        before += rows
    if not pages:
        return df.limit(0)
    return placed.where(reduce(lambda a, b: a | b, pages)).drop(at)


@dataclass
class _Bound:
    """The key of the row with a rank, as far as it is known: ``before`` rows have a smaller one, ``size`` rows have it."""

    rank: int
    levels: list[_Level]
    chosen: list[tuple[_Level, object]] = field(default_factory=list)
    before: int = 0
    size: int | None = None

    def open(self) -> bool:
        return bool(self.levels) and (self.size is None or self.size > NEAR_ROWS)

    def key(self) -> tuple:
        return tuple(value for _, value in self.chosen)

    def equal(self) -> Column:
        return reduce(lambda a, b: a & b, [level.key == F.lit(value) for level, value in self.chosen], F.lit(True))

    def _compared(self, test: str, at_end: Column) -> Column:
        condition = at_end
        for level, value in reversed(self.chosen):
            condition = getattr(level, test)(value) | ((level.key == F.lit(value)) & condition)
        return condition

    def after(self) -> Column:
        return self._compared("after", F.lit(False))

    def reached_or_after(self) -> Column:
        return self._compared("after", F.lit(True))

    def reached(self) -> Column:
        """Rows up to this key, those that have it included."""
        return self._compared("before", F.lit(True))

    def choose(self, level: _Level, value, before: int, size: int) -> None:
        self.levels = self.levels[1:]
        if level.text is not None and value % 8 == 7:
            self.levels = [_piece(level.text, level.piece + 1), *self.levels]
        self.chosen.append((level, value))
        self.before += before
        self.size = size


def _find(df: DataFrame, bounds: list[_Bound]) -> list[_Bound]:
    while any(bound.open() for bound in bounds):
        groups: dict[tuple, list[_Bound]] = {}
        for bound in bounds:
            if bound.open():
                groups.setdefault(bound.key(), []).append(bound)
        for same in groups.values():
            level = same[0].levels[0]
            keys = df.where(same[0].equal()).select(level.key.alias("k"))
            if level.few:
                _choose_counted(_counts(keys, level), level, same)
            else:
                _choose_selected(keys, level, same)
    return bounds


def _counts(keys: DataFrame, level: _Level) -> list[tuple]:
    """The few values of a level in its order, with their rows."""
    return sorted(((row["k"], row["count"]) for row in keys.groupBy("k").count().collect()), reverse=not level.ascending)


def _choose_counted(counts: list[tuple], level: _Level, bounds: list[_Bound]) -> None:
    for bound in bounds:
        before = 0
        for value, size in counts:
            if bound.before + before + size > bound.rank:
                break
            before += size
        bound.choose(level, value, before, size)


def _choose_selected(keys: DataFrame, level: _Level, bounds: list[_Bound]) -> None:
    def places(rows: int) -> list[int]:
        inside = [bound.rank - bound.before for bound in bounds]
        return inside if level.ascending else [rows - 1 - place for place in inside]

    rows, found = order_statistics(keys, "k", places)
    values = [found[place] for place in places(rows)]
    key = replace(level, key=F.col("k"))
    counts = keys.agg(*[count for n, value in enumerate(values) for count in (
        F.count_if(key.before(value)).alias(f"before{n}"), F.count_if(F.col("k") == F.lit(value)).alias(f"size{n}"))]).first()
    for n, (bound, value) in enumerate(zip(bounds, values)):
        bound.choose(level, value, counts[f"before{n}"], counts[f"size{n}"])


def _levels(df: DataFrame, order: Order) -> list[_Level] | None:
    """An order as numbers, or nothing if its type has none."""
    kind, value = type_of(df, order.column), col(order.column)
    # NULL, and NaN, which sorts above all other numbers, stand apart from the values.
    place = F.when(value.isNull(), 0 if order.nulls_come_first() else 3)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        place = place.when(F.isnan(value), 2 if order.ascending else 1)
    group = _Level(place.otherwise(1 if order.ascending else 2), few=True)

    def number(key: Column, few: bool = False) -> _Level:
        return _Level(key, order.ascending, few)

    if isinstance(kind, (T.StringType, T.BinaryType)):
        return [group, _piece(order, 0)]
    if isinstance(kind, T.BooleanType):
        return [group, number(F.coalesce(value, F.lit(False)), few=True)]
    if isinstance(kind, T.LongType):
        # Two halves, as sketches hold doubles.
        return [group, number(F.coalesce(F.shiftright(value, 32), F.lit(0))),
                number(F.coalesce(value.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)))]
    if isinstance(kind, T.DateType):
        return [group, number(F.coalesce(F.unix_date(value), F.lit(0)))]
    if isinstance(kind, T.TimestampType):
        return [group, number(F.coalesce(F.unix_micros(value), F.lit(0)))]
    if isinstance(kind, T.TimestampNTZType):
        start = F.lit("1970-01-01").cast("timestamp_ntz")
        return [group, number(F.coalesce(F.timestamp_diff("MICROSECOND", start, value), F.lit(0)))]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [group, number(F.when(F.isnan(value), 0).otherwise(F.coalesce(value, F.lit(0.0))))]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) or (
            isinstance(kind, T.DecimalType) and kind.precision <= 15):
        return [group, number(F.coalesce(value, F.lit(0).cast(kind)))]
    return None


def _piece(order: Order, piece: int) -> _Level:
    """Some bytes of a text as a number: texts are ordered by their first pieces, then by the next, and so on.

    The last three bits tell how many bytes there are, 7 for more than this piece holds.
    """
    raw = F.coalesce(col(order.column).cast("binary"), F.lit("").cast("binary"))
    part = F.rpad(F.hex(F.substring(raw, piece * CHUNK + 1, CHUNK)), 2 * CHUNK, "0")
    left = F.greatest(F.octet_length(raw) - piece * CHUNK, F.lit(0))
    held = F.when(left > CHUNK, 7).otherwise(left)
    return _Level(F.conv(part, 16, 10).cast("long") * 8 + held, order.ascending, False, order, piece)

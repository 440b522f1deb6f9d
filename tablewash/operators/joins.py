"""Equi-joins, natural joins and semi-joins, safe for hot keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from ..types import ColumnNameClashError, InvalidValueError, NoJoinColumnsError, TypeMismatchError, col, type_of

JOIN_TYPES = ("inner", "left", "right", "full")


def normal_join(left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str],
                how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """Join on pairs of columns; both tables keep all their columns, so names must not overlap.

    ``hot_rows`` is how often a key must occur on the side whose rows do not all stay to be split there (see ``_outer``);
    by default 100,000 times, and tables that Spark sends to every task anyway are not looked at.
    """
    _check_type(how)
    if not left_columns or len(left_columns) != len(right_columns):
        raise InvalidValueError("join columns come in pairs")
    for a, b in zip(left_columns, right_columns):
        _check_same_type(left, a, right, b)
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ColumnNameClashError(f"both tables have columns {sorted(clash)}")
    pairs = list(zip(left_columns, right_columns))
    columns = left.columns + right.columns
    if how == "inner":
        joined = _keyed(left, left_columns).join(_keyed(right, right_columns), _equal(pairs))
    elif how == "left":
        joined = _outer(left, right, pairs, hot_rows)
    elif how == "right":
        joined = _outer(right, left, [(b, a) for a, b in pairs], hot_rows)
    else:
        joined = _full(left, right, pairs, hot_rows, columns)
    return joined.select(*[col(c) for c in columns])


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """Join on all common column names; these come once and first. ``hot_rows`` as in ``normal_join``."""
    _check_type(how)
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise NoJoinColumnsError("the tables have no column name in common")
    for c in common:
        _check_same_type(left, c, right, c)
    columns = [*common, *[c for c in [*left.columns, *right.columns] if c not in common]]
    if how == "inner":
        return _keyed(left, common).join(_keyed(right, common), on=common).select(*[col(c) for c in columns])
    # The keys of one side get other names, so that both can be spoken of.
    taken, names = {*left.columns, *right.columns}, {}
    for c in common:
        names[c] = next(name for n in count() if (name := f"_{n}_{c}") not in taken)
        taken.add(names[c])
    if how == "right":
        left = left.withColumnsRenamed(names)
        joined = _outer(right, left, [(c, names[c]) for c in common], hot_rows)
        return joined.select(*[col(c) for c in columns])
    right = right.withColumnsRenamed(names)
    pairs = [(c, names[c]) for c in common]
    if how == "left":
        return _outer(left, right, pairs, hot_rows).select(*[col(c) for c in columns])
    joined = _full(left, right, pairs, hot_rows, [*left.columns, *right.columns])
    return joined.select(*[F.coalesce(col(c), col(names[c])).alias(c) for c in common],
                         *[col(c) for c in columns[len(common):]])


# Rows and the share of all rows that make a key hot, and how many keys a sketch follows.
HOT_ROWS, HOT_SHARE, FOLLOWED = 100_000, 0.01, 1_000
# Parts a hot key is split into at most.
MOST_PARTS = 256


def _outer(kept: DataFrame, other: DataFrame, pairs: list[tuple[str, str]], hot_rows: int | None) -> DataFrame:
    """All rows of ``kept`` beside their partners in ``other``, safe for a hot key on either side.

    A hot key of ``kept`` is split by Spark itself while it joins. One of ``other`` can't be, as each part would
    have to know whether another one holds a partner. So the keys of ``other`` are counted first by a mergeable sketch. The rows of
    hot ones are dealt into numbered parts and joined with their ``kept`` rows, repeated for each part. All
    these have partners, as the key itself says, so that an inner join does; all other rows meet in a plain left join.
    """
    own, their = [a for a, _ in pairs], [b for _, b in pairs]
    other = _keyed(other, their)
    hot, parts = _hot_keys(other, their, hot_rows)
    if hot is None:
        return kept.join(other, _equal(pairs), "left")
    # At most some hundred keys, as many as a sketch can find above the share.
    hot = F.broadcast(hot.toDF(*[f"_hot{n}" for n in range(len(pairs))]))

    def split(df: DataFrame, names: list[str], how: str) -> DataFrame:
        return df.join(hot, _equal([(name, f"_hot{n}") for n, name in enumerate(names)]), how)

    columns = kept.columns + other.columns
    number, spread = _free_name(columns, "_part"), _free_name(columns, "_parts")
    cold = split(kept, own, "left_anti").join(split(other, their, "left_anti"), _equal(pairs), "left")
    repeated = split(kept, own, "left_semi").withColumn(number, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = split(other, their, "left_semi").withColumn(
        spread, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    warm = repeated.join(dealt, _equal([*pairs, (number, spread)])).drop(number, spread)
    return cold.unionByName(warm)


def _hot_keys(df: DataFrame, columns: list[str], hot_rows: int | None) -> tuple[DataFrame | None, int]:
    """Keys that make up many rows, and into how many parts the hottest is to be split."""
    if hot_rows is None and _is_sent(df):
        return None, 0
    least = hot_rows or HOT_ROWS
    key = F.xxhash64(*[col(c) for c in columns])
    total, top = df.select(key.alias("k")).agg(F.count(F.lit(1)), F.call_function(
        "approx_top_k", F.col("k"), F.lit(int(1 / HOT_SHARE)), F.lit(FOLLOWED))).first()
    # Sketched counts may be too high, which costs a needless split and changes no result.
    hashes = [row["item"] for row in top or [] if row["count"] >= max(least, HOT_SHARE * total)]
    if not hashes:
        return None, 0
    most = max(row["count"] for row in top)
    found = checkpoint(df.where(key.isin(hashes)).select(*[col(c) for c in columns]).distinct())
    return found, min(MOST_PARTS, max(2, -(-most // least)))


def _is_sent(df: DataFrame) -> bool:
    """Whether Spark takes a table for small enough to be sent to every task, where no key is hot."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def _full(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], hot_rows: int | None,
          columns: list[str]) -> DataFrame:
    own = [a for a, _ in pairs]
    joined = _outer(_keyed(left, own), right, pairs, hot_rows)
    return _stacked([joined, *_unmatched(right, left, [(b, a) for a, b in pairs]), _keyless(left, own)], columns)


def _free_name(taken: Iterable[str], name: str) -> str:
    taken = set(taken)
    while name in taken:
        name += "_"
    return name


def semi_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str) -> DataFrame:
    """Rows of ``left`` whose value occurs in a column of ``right``; repeats on the right do not matter."""
    _check_same_type(left, left_column, right, right_column)
    keys = right.select(col(right_column).alias("_key")).distinct()
    return left.join(keys, col(left_column) == F.col("_key"), "left_semi")


def _keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(_all(col(c).isNotNull() for c in columns))


def _unmatched(df: DataFrame, other: DataFrame, pairs: list[tuple[str, str]]) -> list[DataFrame]:
    """Rows of ``df`` without partner: those whose key is unknown on the other side or NULL.

    A full join can split a hot key on neither side. A left join and an anti join can, on the side whose rows all
    stay; the anti join only meets the distinct keys of the other side. Its input is the same as that of
    the left join, so that both read one shuffle; rows with a NULL key are not shuffled at all.
    """
    own, their = [a for a, _ in pairs], [b for _, b in pairs]
    keys = _keyed(other, their).select(*[col(b).alias(f"_key{i}") for i, b in enumerate(their)]).distinct()
    strange = _keyed(df, own).join(keys, _equal([(a, f"_key{i}") for i, a in enumerate(own)]), "left_anti")
    return [strange, _keyless(df, own)]


def _keyless(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(~_all(col(c).isNotNull() for c in columns))


def _stacked(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*[col(c) for c in columns])


def _equal(pairs: list[tuple[str, str]]) -> Column:
    return _all(col(a) == col(b) for a, b in pairs)


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _check_type(how: str) -> None:
    if how not in JOIN_TYPES:
        raise InvalidValueError(f"join type is one of {JOIN_TYPES}")


def _check_same_type(left: DataFrame, a: str, right: DataFrame, b: str) -> None:
    if type_of(left, a) != type_of(right, b):
        raise TypeMismatchError(f'columns "{a}" and "{b}" have different types')

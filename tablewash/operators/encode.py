"""One-hot encoding and Z-score normalisation, split into fit and apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..naming import clashing_names, unique_name
from ..types import InvalidValueError, col, is_numeric, number, require_numeric, type_of


# Distinct values a column may have unless the caller says otherwise: each becomes a column.
MOST_CATEGORIES = 2_000
# Values that a row is compared with one by one.
MOST_COMPARED = 64


def fit_one_hot(df: DataFrame, column: str, max_categories: int = MOST_CATEGORIES) -> dict:
    """The distinct values in ascending order; NaN counts as NULL. More than ``max_categories`` are refused.

    No more values than that and one reach the driver.
    """
    value = number(df, column) if is_numeric(type_of(df, column)) else col(column)
    distinct = df.select(value.alias("v")).where("v IS NOT NULL").distinct().orderBy("v")
    rows = distinct.limit(max_categories + 1).collect()
    if len(rows) > max_categories:
        raise InvalidValueError(f'column "{column}" has more than {max_categories} distinct values')
    return {"categories": [row["v"] for row in rows]}


def apply_one_hot(df: DataFrame, column: str, params: dict) -> DataFrame:
    """Replace the column by one 0/1 column per value, named by the value.

    Values that the session's case rule takes for one name get numbered names, in their order.
    """
    kept = [c for c in df.columns if c != column]
    clash = clashing_names(kept, [str(value) for value in params["categories"]])
    if clash:
        raise InvalidValueError(f"columns {clash} exist already")
    names: list[str] = []
    for value in params["categories"]:
        names.append(unique_name([*kept, *names], str(value)))
    kind = type_of(df, column)
    # Plain comparisons stay small wherever the optimizer copies them to, unlike one expression that all flags share.
    values, wanted = col(column), [F.lit(value).cast(kind) for value in params["categories"]]
    if len(names) > MOST_COMPARED:
        # So the place of a value among many is joined, once for all flags.
        key, place = unique_name(df.columns, "_category"), unique_name(df.columns, "_place")
        places = df.sparkSession.range(1).select(F.posexplode(F.array(*wanted)).alias(place, key))
        df = df.join(F.broadcast(places), col(column) == col(key), "left")
        values, wanted = col(place), [F.lit(n) for n in range(len(names))]
    flags = [F.coalesce((values == value).cast("int"), F.lit(0)).alias(name) for value, name in zip(wanted, names)]
    return df.select(*[col(c) for c in kept], *flags)


def one_hot_encode(df: DataFrame, column: str, max_categories: int = MOST_CATEGORIES) -> DataFrame:
    return apply_one_hot(df, column, fit_one_hot(df, column, max_categories))


def fit_zscore(df: DataFrame, column: str) -> dict:
    """Mean and population standard deviation."""
    require_numeric(df, column)
    value = number(df, column).cast("double")
    mean, deviation = df.agg(F.avg(value), F.stddev_pop(value)).first()
    return {"mean": mean, "deviation": deviation}


def apply_zscore(df: DataFrame, column: str, params: dict, overwrite: bool = True,
                 low_clamp: str = "reference") -> DataFrame:
    """Scores cut at two deviations and moved into [0, 1].

    Low scores beyond the cut are set to +2, hence 1.0, unless ``low_clamp`` is "symmetric".
    Without any spread the values stay as they are.
    """
    require_numeric(df, column)
    if low_clamp not in ("reference", "symmetric"):
        raise InvalidValueError("low_clamp is reference or symmetric")
    target = column if overwrite else unique_name(df.columns, f"{column}_normalized")
    value = number(df, column).cast("double")
    if not params["deviation"]:
        return df.withColumn(target, value)
    score = (value - F.lit(params["mean"])) / F.lit(params["deviation"])
    lowest = 2.0 if low_clamp == "reference" else -2.0
    cut = F.when(score > 2, 2.0).when(score < -2, lowest).otherwise(score)
    return df.withColumn(target, cut / 4 + 0.5)


def zscore_normalize(df: DataFrame, column: str, overwrite: bool = True, low_clamp: str = "reference") -> DataFrame:
    return apply_zscore(df, column, fit_zscore(df, column), overwrite, low_clamp)

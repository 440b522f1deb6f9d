"""Statistics of columns, frequency charts, histograms and pages of a table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import Order, page_rows, unsorted_page
from ..functions.trees import by_edges
from ..types import InvalidValueError, col, is_numeric, number, type_of

# Shown for columns without such a statistic, and for the rest of a frequency chart.
NOT_AVAILABLE = "N/A"
OTHER = "other"
# Values rarer than one in this many rows are folded into the rest.
FOLD_BELOW = 20


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def column_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(_numeric_only(df, column, F.max(number(df, column))).alias("max"))


def column_min(df: DataFrame, column: str) -> DataFrame:
    return df.agg(_numeric_only(df, column, F.min(number(df, column))).alias("min"))


def column_avg(df: DataFrame, column: str) -> DataFrame:
    return df.agg(_numeric_only(df, column, F.avg(number(df, column))).alias("avg"))


def null_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(col(column).isNull()).alias("null_count"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL being a value of its own."""
    type_of(df, column)
    return df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("frequency"))


def most_frequent_value(df: DataFrame, column: str) -> DataFrame:
    """The commonest value; the smallest of several, NULL last."""
    return value_counts(df, column).orderBy(F.desc("frequency"), F.asc_nulls_last("value")).limit(1)


def frequency_chart(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, commonest first; values below five percent of all rows form one last entry.

    At most 20 values reach five percent, so only the folding of the others is distributed work.
    """
    total = df.count()
    rare = F.col("frequency") * FOLD_BELOW < F.lit(total)
    folded = (value_counts(df, column)
              .select(rare.alias("is_other"), "frequency",
                      F.when(rare, OTHER).otherwise(F.col("value").cast("string")).alias("label"),
                      F.when(~rare, F.col("value")).alias("value"))
              .groupBy("is_other", "value", "label").agg(F.sum("frequency").alias("frequency")))
    return (folded.orderBy("is_other", F.desc("frequency"), F.asc_nulls_last("value"))
            .select("label", "frequency", "is_other"))


def frequent_values(df: DataFrame, column: str, having: Column) -> DataFrame:
    """Groups of equal values whose count (column ``frequency``) meets a condition."""
    return value_counts(df, column).where(having)


# Values a sketch follows, how far its counts can be off (as a share of all rows), and the most values it names.
FOLLOWED, SKETCH_ERROR, NAMED = 4_000, 3.5 / 4_000, 32


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: row and NULL counts, minimum, maximum, mean and most frequent value as text.

    All counts, extremes and means come from one aggregate, and with them a mergeable sketch of each column's most frequent
    values. It leaves out no value that could be the most frequent one of a column where one value stands out
    by more than the sketch can be wrong; there a second pass counts the named values exactly, ties included, and passes over all
    others. Only columns without such a value (keys, mostly) have all their values counted, in the same pass.
    """
    names = columns or df.columns
    measures = []
    for i, name in enumerate(names):
        value = number(df, name)
        numeric = is_numeric(type_of(df, name))
        measures.append(F.struct(
            F.lit(name).alias("column"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(col(name).isNull()).alias("null_count"),
            *[(F.coalesce(f(value).cast("string"), F.lit("")) if numeric else F.lit(NOT_AVAILABLE)).alias(label)
              for label, f in (("min", F.min), ("max", F.max))],
            (F.avg(value).cast("double") if numeric else F.lit(None).cast("double")).alias("avg"),
            F.call_function("approx_top_k", col(name).cast("string"), F.lit(NAMED), F.lit(FOLLOWED)).alias("top"),
        ).alias(f"m{i}"))
    rows = df.agg(*measures).first()
    summary = df.sparkSession.createDataFrame(
        [tuple(row)[:6] for row in rows], "`column` string, row_count long, null_count long, min string, max string, avg double")
    entries = []
    for row, name in zip(rows, names):
        value = col(name).cast("string")
        entry = F.struct(F.lit(name).alias("column"), value.alias("value"), (
            number(df, name).cast("double") if is_numeric(type_of(df, name)) else F.lit(None).cast("double")).alias("size"))
        named = _contenders(row)
        # None of the others can be the most frequent value, so they need not be counted.
        entries.append(entry if named is None else F.when(value.isNull() | value.isin(named), entry))
    counts = (df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.column", "e.value", "e.size")
              .agg(F.count(F.lit(1)).alias("frequency")))
    # The commonest value; of several the smallest, as a number or as text, NULL last.
    first = F.min(F.struct(-F.col("frequency"), F.col("value").isNull(), F.isnan("size") | F.col("size").isNull(), "size",
                           "value"))
    modes = counts.groupBy("column").agg(first.alias("m")).select(
        "column", F.col("m.value").alias("most_frequent"), (-F.col("m.col1")).alias("most_frequent_count"))
    return summary.join(modes, "column", "left")


def _contenders(row) -> list[str] | None:
    """The values one of which is a column's most frequent (besides NULL), or none if the sketch leaves it open."""
    top = [(entry["item"], entry["count"]) for entry in row["top"] or [] if entry["item"] is not None]
    values = row["row_count"] - row["null_count"]
    error = SKETCH_ERROR * values
    most = max([count - error for _, count in top] + [float(row["null_count"])], default=0.0)
    if values and (not top or most <= error or (len(top) >= NAMED - 1 and min(count for _, count in top) >= most)):
        return None
    return [value for value, count in top if count >= most]


def histogram(df: DataFrame, column: str, bins: int = 10, compat: str | None = None) -> DataFrame:
    """Rows per bin between minimum and maximum: ``(bin, label, frequency)``.

    ``compat="greedy"`` moves on by one bin per value at most, so after a gap values land in
    earlier bins than their size asks for and the maximum opens a bin of its own.
    """
    if compat not in (None, "greedy"):
        raise InvalidValueError('compat is None or "greedy"')
    if bins < 1:
        raise InvalidValueError("at least one bin is needed")
    spark = df.sparkSession
    shape = "bin int, label string, frequency long"
    if not is_numeric(type_of(df, column)):
        return spark.createDataFrame([], shape)
    value = number(df, column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return spark.createDataFrame([], shape)
    if math.isinf(low) or math.isinf(high):
        raise InvalidValueError(f'column "{column}" holds an infinite number')
    if compat == "greedy" and high > low:
        return _greedy_histogram(df, value, low, high, bins)
    width = (high - low) / bins
    if not width:
        place, edges = F.lit(0), [low, low]
    else:
        place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        edges = [low + i * width for i in range(bins)] + [high]
    counts = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    every = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("frequency"))
    label = F.element_at(F.array(*[F.lit(text) for _, text in _labels(edges)]), F.col("bin") + 1)
    return (counts.unionByName(every).groupBy("bin").agg(F.sum("frequency").alias("frequency"))
            .select("bin", label.alias("label"), "frequency").orderBy("bin"))


def _greedy_histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """The greedy walk, computed from the number of rows between each two edges.

    Walking the sorted values, row i ends in bin min(t_j + i - j) over all j <= i, where t is the
    number of edges at or below a value. Rows between the same two edges share t, so within such
    a run that starts at row s the bin rises by one per row from its start until it reaches t.
    """
    width = (high - low) / bins
    edges = [max(low + width, math.nextafter(low, math.inf))]
    while edges[-1] <= high:
        # Far from zero the width can vanish in rounding; the walk goes on to the next number there is.
        edges.append(max(edges[-1] + width, math.nextafter(edges[-1], math.inf)))
    counts = (df.where(value.isNotNull())
              .groupBy(by_edges(value, edges, lambda count: F.lit(count)).alias("run")).count().collect())
    sizes: dict[int, int] = {}
    current = 0
    for run, rows in sorted((row["run"], row["count"]) for row in counts):
        while rows and current < run:
            current += 1
            sizes[current] = sizes.get(current, 0) + 1
            rows -= 1
        sizes[current] = sizes.get(current, 0) + rows
    used = max(sizes) + 1
    labels = _labels([low, *edges[:used]])
    rows = [(number_, label, sizes.get(number_, 0)) for number_, label in labels]
    return df.sparkSession.createDataFrame(rows, "bin int, label string, frequency long").orderBy("bin")


def _labels(edges: list[float]) -> list[tuple[int, str]]:
    return [(i, f"({math.ceil(a)}, {math.floor(b)})") for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def _numeric_only(df: DataFrame, column: str, statistic: Column) -> Column:
    return statistic if is_numeric(type_of(df, column)) else F.lit(NOT_AVAILABLE)


def page(df: DataFrame, offset: int, limit: int, on_column: str | None = None, ascending: bool = True,
         tiebreak: list[str] | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit``, optionally ordered by one column.

    NULL sorts above every value: last when ascending, first when descending. ``tiebreak`` columns
    make the page deterministic.
    """
    if on_column is None:
        return unsorted_page(df, offset, limit)
    type_of(df, on_column)
    return page_rows(df, [Order(on_column, ascending), *[Order(c) for c in tiebreak or []]], offset, limit)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Every row as a JSON array in the text column ``row``; values JSON does not know become text."""
    cells = []
    for field in df.schema.fields:
        cell = col(field.name)
        kind = field.dataType.typeName()
        if is_numeric(field.dataType) and kind != "decimal" or kind == "boolean":
            text = cell.cast("string")
        else:
            quoted = F.to_json(F.array(cell.cast("string")))
            text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        cells.append(F.when(cell.isNull(), "null").otherwise(text))
    return df.select(F.concat(F.lit("["), F.concat_ws(", ", *cells), F.lit("]")).alias("row"))

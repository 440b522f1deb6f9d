"""CSV files: read as plain text, read with inferred types, written with chosen signs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint, scratch_folder
from ..types import EmptyFileError, InvalidValueError, col
from .ranges import CHANGED, by_range, in_order, read_ranges, twice, whole

# Fixed value: the spelling of NULL in raw files.
RAW_NULL = "\\N"
# Date layouts tried for text columns, in this order.
DATE_LAYOUTS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy"]
TIME_LAYOUT = "[ H:m[:s]]"


def column_names(first_line: str, header: bool) -> list[str]:
    """Names from the header line, blanks turned into underscores, or ``column_0`` ... without header."""
    cells = first_line.rstrip("\r\n").split(",")
    if not header:
        return [f"column_{i}" for i in range(len(cells))]
    return [cell.strip().replace(" ", "_") for cell in cells]


def raw_cell(column: Column) -> Column:
    """NULL is spelled out in raw files; an empty cell is an empty string."""
    return F.when(column == RAW_NULL, None).otherwise(F.coalesce(column, F.lit("")))


def read_csv_raw(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All columns as text, comma separated, no quoting; a row of another width fails the job."""
    first = spark.read.text(path).first()
    if first is None:
        raise EmptyFileError(path)
    names = column_names(first["value"], header)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    # Rows of another width are only noticed while no column is pruned from the parser.
    df = (spark.read.schema(schema).option("quote", "").option("mode", "FAILFAST").option("header", header)
          .option("enforceSchema", True).option("columnPruning", False).csv(path))
    return df.select(*[raw_cell(F.col(f"_{i}")).alias(name) for i, name in enumerate(names)])


def read_csv_typed(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Columns with inferred types; text columns that hold only dates become dates.

    Quoted cells may hold line breaks. One pass reads the files by byte ranges (``ranges``) and finds where records
    end. If each line is a record, Spark reads the files as they are. Otherwise a second pass cuts the records, range by
    range, and writes their cells to the scratch folder; no file is ever read by one task because of a line break.
    The types come from one aggregate over the cells. A column keeps its time of day when any value has one. A file whose
    last quoted cell does not end is refused.
    """
    if spark.read.text(path).first() is None:
        raise EmptyFileError(path)
    options = {"escape": '"', "nullValue": "NULL", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    names = spark.read.options(header=header, multiLine=True, **options).csv(path).columns
    if not header:
        names = [f"column_{i}" for i in range(len(names))]
    cells = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    folder = twice(lambda: _cut(spark, path, header, cells, options))
    df = (spark.read.schema(cells).options(header=header, enforceSchema=True, **options).csv(path) if folder is None
          else spark.read.schema(cells).parquet(folder))
    return df.select(*[value.alias(name) for value, name in zip(_typed(df), names)])


def _cut(spark: SparkSession, path: str, header: bool, cells: T.StructType, options: dict) -> str | None:
    """A folder of cells, or none if every line is a record."""
    lines = read_ranges(spark, path, "\n")
    begins = _beginnings(lines.mapInArrow(_answers, "file long, start long, to_in array<boolean>, closed array<boolean>, "
                                                    "goes_on array<boolean>"), header)
    if begins is None:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cutter = None, None
        for file, start, values in by_range(batches):
            if place != (file, start):
                if cutter is not None:
                    yield cutter.close()
                place = file, start
                if place not in begins:
                    raise RuntimeError(CHANGED)
                cutter = _Cutter(file, start, *begins[place])
            yield cutter.feed(values)
        if cutter is not None:
            yield cutter.close()

    pieces = checkpoint(lines.mapInArrow(cut, "record string, owner long, file long, place long"))
    folder = f"{scratch_folder(spark)}/cells"
    plain = {key: str(value).lower() if isinstance(value, bool) else value for key, value in options.items()}
    records = whole(pieces, [], "record", "\n").where(F.trim(F.regexp_replace("record", "[\r\n]", "")) != "")
    (records.select(F.from_csv(F.regexp_replace("record", "\r$", ""), cells.simpleString()[7:-1].replace(":", " "),
                               {**plain, "multiLine": "true"}).alias("c")).select("c.*").write.parquet(folder))
    return folder


def line_end(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line, if one was or was not at its beginning."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def _states(values: pa.Array, inside: bool) -> np.ndarray:
    """Whether a quoted cell is open after each line."""
    quoted = np.flatnonzero(pc.fill_null(pc.count_substring(values, '"'), 0).to_numpy(zero_copy_only=False))
    after = np.zeros(len(values), dtype=bool)
    if not len(quoted):
        after[:] = inside
        return after
    last = 0
    for place, line in zip(quoted, values.take(pa.array(quoted)).to_pylist()):
        after[last:place] = inside
        inside = line_end(line, inside)
        last = place
    after[last:] = inside
    return after


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and both beginnings: is a cell open at the end, did a record end, does one go on past a line."""
    found: dict[tuple[int, int], list[list[bool]]] = {}
    for file, start, values in by_range(batches):
        answer = found.setdefault((file, start), [[False, True], [False, False], [False, False]])
        for n in (0, 1):
            after = _states(values, answer[0][n])
            answer[0][n] = bool(after[-1])
            answer[1][n] |= not after.all()
            answer[2][n] |= bool(after.any())
    rows = [(*place, *answer) for place, answer in found.items()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64()] + [pa.list_(pa.bool_())] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                                     names=["file", "start", "to_in", "closed", "goes_on"])


def _beginnings(answers: DataFrame, header: bool) -> dict[tuple[int, int], tuple] | None:
    """For each range whether it begins inside a record, that record's owner, and how many records or fragments are header.

    None if no record is longer than a line.
    """
    begins, spanning = {}, False
    for file, rows in in_order(answers).items():
        inside, owner, skip = False, None, header
        for row in rows:
            begins[file, row["start"]] = (inside, owner, skip)
            spanning |= row["goes_on"][inside]
            closed = row["closed"][inside]
            # A header that goes on beyond its range is passed over in the next ones too.
            skip = skip and not closed
            inside, owner = row["to_in"][inside], row["start"] if closed or owner is None else owner
            owner = owner if inside else None
        if inside:
            raise InvalidValueError("the last quoted cell of a file does not end")
    return begins if spanning else None


class _Cutter:
    """Cuts the records of a range; the first and the last may be fragments."""

    def __init__(self, file: int, start: int, inside: bool, owner: int | None, skip: bool):
        self.file, self.start, self.inside, self.owner, self.skip = file, start, inside, owner, skip
        self.lines: list[str] = []

    def feed(self, values: pa.Array) -> pa.RecordBatch:
        after = _states(values, self.inside)
        done: list[tuple] = []
        if not self.inside and not self.skip and not after.any():
            return self._batch(done, values)
        for line, goes_on in zip(values.to_pylist(), after):
            self.lines.append(line)
            if not goes_on:
                self._leave(done, self.owner)
                self.owner, self.skip = None, False
        self.inside = bool(after[-1])
        return self._batch(done)

    def close(self) -> pa.RecordBatch:
        done: list[tuple] = []
        if self.lines:
            self._leave(done, self.start if self.owner is None else self.owner)
        return self._batch(done)

    def _leave(self, done: list[tuple], owner: int | None) -> None:
        if not self.skip:
            done.append(("\n".join(self.lines), owner))
        self.lines = []

    def _batch(self, done: list[tuple], records: pa.Array | None = None) -> pa.RecordBatch:
        texts, owners = zip(*done) if done else ([], [])
        records = pa.array(texts, pa.string()) if records is None else records
        owners = pa.array(owners, pa.int64()) if done else pa.nulls(len(records), pa.int64())
        places = [pa.array(np.full(len(records), n), pa.int64()) for n in (self.file, self.start)]
        return pa.RecordBatch.from_arrays([records, owners, *places], names=["record", "owner", "file", "place"])


# Kinds of numbers, each holding the values of those before it, and what a pattern says of one value.
NUMBERS = ("int", "bigint", "decimal", "double")
_WHOLE, _BROKEN = r"^[+-]?\d{1,38}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^-?(NaN|Infinity)$"
_ISO, _DATE = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d.*)?$", r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}( .*)?$"
# How well values fit a layout of dates: all are days, some have a time, some don't fit.
DAYS, TIMES, NO_DATES = 1, 2, 3


def _typed(df: DataFrame) -> list[Column]:
    """The columns of ``df``, all text, each in the first type that holds all its values.

    Every column has a few measures that are greatest over its values: how wide a number must be, and how well each layout
    of dates fits. So one aggregate of all columns finds all types.
    """
    measures = [measure for name in df.columns for measure in (
        F.count(col(name)), F.max(_number_width(col(name))),
        F.max(F.length(F.regexp_replace(F.regexp_extract(col(name), _WHOLE, 0), "^[+-]?0*", ""))),
        F.max(F.when(col(name).isNotNull(), ~F.lower(col(name)).isin("true", "false"))),
        *[F.max(_fit(col(name), layout)) for layout in (None, *DATE_LAYOUTS)])]
    found = df.agg(*[measure.alias(str(n)) for n, measure in enumerate(measures)]).first()
    size = len(measures) // len(df.columns)
    return [_as_type(col(name), *found[n * size:(n + 1) * size]) for n, name in enumerate(df.columns)]


def _number_width(value: Column) -> Column:
    return (F.when(value.isNull(), None)
            .when(value.rlike(_WHOLE), F.when(value.try_cast("int").isNotNull(), 0)
                  .when(value.try_cast("bigint").isNotNull(), 1).otherwise(2))
            .when(value.rlike(_BROKEN), 3).otherwise(4))


def _moment(value: Column, layout: str | None) -> Column:
    if layout is None:
        return F.when(value.rlike(_ISO), value.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(value.rlike(_DATE), F.try_to_timestamp(value, F.lit(layout + TIME_LAYOUT)).cast("timestamp_ntz"))


def _fit(value: Column, layout: str | None) -> Column:
    moment = _moment(value, layout)
    return (F.when(value.isNull(), None).when(moment.isNull(), NO_DATES)
            .when(moment != F.date_trunc("day", moment), TIMES).otherwise(DAYS))


def _as_type(value: Column, rows: int, width: int | None, digits: int | None, not_truth: bool | None, *fits: int) -> Column:
    if not rows:
        return value
    if width < len(NUMBERS):
        kind = NUMBERS[width]
        return value.cast(f"decimal({max(digits, 1)},0)" if kind == "decimal" else kind)
    for layout, fit in zip((None, *DATE_LAYOUTS), fits):
        if fit < NO_DATES:
            return _moment(value, layout).cast("date" if fit == DAYS else "timestamp_ntz")
    return value if not_truth else value.cast("boolean")


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quotechar: str = '"', null: str = "NULL") -> None:
    """Header and rows; quotes inside quoted cells are doubled, NULL is written as ``null``."""
    if len(delimiter) != 1 or len(quotechar) != 1:
        raise InvalidValueError("delimiter and quote are single characters")
    if len(null) > 10:
        raise InvalidValueError("the word for NULL has at most 10 characters")
    (df.write.mode("errorifexists").option("header", True).option("sep", delimiter).option("quote", quotechar)
     .option("escape", quotechar).option("emptyValue", "").option("nullValue", null)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))

"""SQL dumps: CREATE TABLE and INSERT INTO statements as text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..naming import check_table_name
from ..session import checkpoint, scratch_folder
from ..types import DumpInconsistencyError, EmptyFileError, NoTablesInDumpError, col, column_types, is_numeric
from . import sqltext
from .ranges import CHANGED, by_range, in_order, read_ranges, twice, whole

# SQL type names and the Spark types they are read as.
DECLARED = {
    "int": "int", "integer": "int", "int4": "int", "serial": "int", "smallint": "smallint", "int2": "smallint",
    "bigint": "bigint", "int8": "bigint", "bigserial": "bigint", "real": "float", "float4": "float",
    "float": "double", "float8": "double", "double": "double", "numeric": "decimal", "decimal": "decimal",
    "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
}
CONSTRAINTS = ("primary", "unique", "foreign", "constraint", "check", "exclude")
CREATE = r'(?is)^\s*create\s+table\s+(?:if\s+not\s+exists\s+)?"?([^"\s(]+)"?\s*\((.*)\)\s*$'
# One cell of a row. Text in quotes is taken as a whole and without backtracking, so that long texts need no stack.
CELL = r"((?:'[^']*+')++|[^,'\s]++(?:\s++[^,'\s]++)*+)"
# Records that Spark reads a dump by: hardly anything but a text or a comment is longer than what ends by a bracket.
RECORD_END = ")"


def read_sql_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables created by a dump, with the rows it inserts; all other statements are ignored.

    Statements, rows and texts are told apart as SQL does: texts may hold semicolons, brackets, doubled quotes and line
    breaks, ``E'...'`` also backslashes; comments and quoted names are known too. Files are read by byte ranges (see
    ``ranges``), each by one task, so a statement with any number of rows is read by many tasks. The rows are
    written to the scratch folder once, by table. A file that ends inside a text is refused. Function bodies in dollar
    signs are read as plain SQL, so their quotes have to match.
    """
    cut = twice(lambda: _cut(spark, path))
    created = [row["text"] for row in cut.where("kind = 'create'").select("text").collect()]
    if not created:
        if spark.read.text(path).first() is None:
            raise EmptyFileError(path)
        raise NoTablesInDumpError(path)
    rows = cut.where("kind = 'row'")
    return {name: _inserted(rows, name, columns) for name, columns in map(_declaration, created)}


def _cut(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, table, names, text)``: rows of INSERT statements and CREATE TABLE statements, from a scratch folder."""
    records = read_ranges(spark, path, RECORD_END)
    begins = _beginnings(checkpoint(records.mapInArrow(_answers, "file long, start long, mode int, to_mode int, "
                                                                 "ended boolean, depth int, low int, head string")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, place = None, None
        for file, start, values in by_range(batches):
            if place != (file, start):
                if cutter is not None:
                    yield _leaving(place, cutter, begins[place][-1])
                place = file, start
                if place not in begins:
                    raise RuntimeError(CHANGED)
                cutter = sqltext.Cutter(start, *begins[place][:-1])
            cutter.feed(_text(values))
            if len(cutter.done) >= ROWS:
                yield _leaving(place, cutter, None)
        if cutter is not None:
            yield _leaving(place, cutter, begins[place][-1])

    folder = f"{scratch_folder(spark)}/rows"
    kinds = "kind string, table string, names string, text string, owner long, file long, place long"
    pieces = records.mapInArrow(cut, kinds)
    if any(row[3] is not None for row in begins.values()):
        pieces = whole(checkpoint(pieces), ["kind", "table", "names"], "text", "")
    pieces.select("kind", "table", "names", "text").write.partitionBy("kind", "table").parquet(folder)
    return spark.read.schema("names string, text string, kind string, table string").parquet(folder)


# Rows that leave a task at a time.
ROWS = 4096


def _text(values: pa.Array) -> str:
    return RECORD_END.join(values.to_pylist()) + RECORD_END


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range leads to from each mode; modes that have come to the same are followed as one."""
    found: dict[tuple[int, int], dict] = {}
    for file, start, values in by_range(batches):
        text = _text(values)
        spans = found.setdefault((file, start), {mode: sqltext.Span(mode) for mode in sqltext.MODES})
        later = {mode: sqltext.span(text, mode) for mode in {span.mode for span in spans.values()}}
        for mode, span in spans.items():
            spans[mode] = span.then(later[span.mode])
    rows = [(*place, mode, span.mode, span.ended, span.depth, span.low, sqltext.shortened(span.head, span.ended))
            for place, spans in found.items() for mode, span in spans.items()]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=[
        "file", "start", "mode", "to_mode", "ended", "depth", "low", "head"])


def _beginnings(answers: DataFrame) -> dict[tuple[int, int], tuple]:
    """For each range the mode, depth and head it begins with, the owner of its first row, and whether it ends a file.

    The modes are composed first, from a number per range and mode; heads are asked for only where they are true.
    """
    steps: dict[tuple[int, int], dict[int, int]] = {}
    for row in answers.select("file", "start", "mode", "to_mode").collect():
        steps.setdefault((row["file"], row["start"]), {})[row["mode"]] = row["to_mode"]
    true, mode, last = [], sqltext.PLAIN, None
    for file, start in sorted(steps):
        mode = mode if file == last else sqltext.PLAIN
        true.append((file, start, mode))
        mode, last = steps[file, start][mode], file
    if not true:
        return {}
    modes = answers.sparkSession.createDataFrame(true, "file long, start long, mode int")
    begins = {}
    for file, rows in in_order(answers.join(modes, ["file", "start", "mode"])).items():
        state, owner = sqltext.Span(sqltext.PLAIN), None
        for row in rows:
            begins[file, row["start"]] = (state.mode, state.depth, state.head, owner, row is rows[-1])
            closed = row["ended"] or state.depth + row["low"] <= 0
            state = state.then(sqltext.Span(row["to_mode"], row["ended"], row["depth"], row["low"], row["head"]))
            state = replace(state, head=sqltext.shortened(state.head, True))
            open_row = state.depth > 0 and sqltext.adds_rows(state.head) is not None
            owner = None if not open_row else row["start"] if closed or owner is None else owner
        # The last record is given a bracket that the file may not have.
        if state.mode not in (sqltext.PLAIN, sqltext.LINE) or state.depth > 0:
            raise DumpInconsistencyError(f"a file ends inside of {state.head[-200:]!r}")
    return begins


def _leaving(place: tuple[int, int], cutter: sqltext.Cutter, last: bool | None) -> pa.RecordBatch:
    """The pieces a cutter holds; at the end of a range (``last`` is known) also the fragment that stays open."""
    if last is not None:
        cutter.close(last)
    done, cutter.done = cutter.done, []
    columns = list(zip(*done)) if done else [[]] * 5
    count = len(done)
    arrays = [pa.array(c, pa.string()) for c in columns[:4]] + [
        pa.array(columns[4], pa.int64()), pa.array([place[0]] * count, pa.int64()),
        pa.array([place[1]] * count, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "table", "names", "text", "owner", "file", "place"])


def _declaration(statement: str) -> tuple[str, dict[str, str]]:
    match = re.match(CREATE, statement)
    if not match:
        raise DumpInconsistencyError(statement[:200])
    columns = {}
    for part in re.split(r",(?![^()]*\))", match[2]):
        words = re.match(r'\s*(?:"([^"]+)"|(\S+))\s+(\w+)\s*(\([\d\s,]+\))?', part)
        if not words or (words[2] or "").lower().split("(")[0] in CONSTRAINTS:
            continue
        kind = DECLARED.get(words[3].lower(), "string")
        columns[words[1] or words[2]] = kind + (words[4] or "(38,18)") if kind == "decimal" else kind
    if not columns:
        raise DumpInconsistencyError(statement[:200])
    return check_table_name(match[1]), columns


def _inserted(rows: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """Rows of one table; INSERTs may name their columns in any order."""
    declared = F.array(*[F.lit(c) for c in columns])
    named = F.transform(F.split("names", ","), lambda n: F.trim(F.replace(n, F.lit('"'), F.lit(""))))
    failure = F.raise_error(F.concat(F.lit("cannot read row of the dump: "), F.substring("text", 1, 200)))
    # Where a column stands among the cells: its place in the declaration, or in the names of the statement.
    names = F.when(F.trim(F.coalesce("names", F.lit(""))) == "", declared).otherwise(named)
    places = F.transform(declared, lambda c: F.array_position(names, c).cast("int"))
    one = (rows.where(F.col("table") == table)
           .select("text", F.size(names).alias("width"), places.alias("places"),
                   F.regexp_extract_all("text", F.lit(CELL), F.lit(1)).alias("cells")))
    cells = F.when(F.size("cells") <= F.col("width"), F.col("cells")).otherwise(failure.cast("array<string>"))
    one = one.select(cells.alias("cells"), "places")
    return one.select(*[_value(F.get("cells", F.col("places")[i] - 1)).cast(kind).alias(c)
                        for i, (c, kind) in enumerate(columns.items())])


def _value(cell: Column) -> Column:
    bare = F.substring(cell, F.lit(2), F.length(cell) - 2)
    text = F.replace(bare, F.lit("''"), F.lit("'"))
    return F.when(cell.startswith("'"), text).when(F.upper(cell) != "NULL", cell)


def create_statement(df: DataFrame, table: str) -> str:
    columns = ", ".join(f'"{name}" {kind}' for name, kind in column_types(df).items())
    return f'CREATE TABLE "{table}" ({columns});'


def sql_dump_rows(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row in the text column ``value``; each stands for itself in any file."""
    cells = []
    for field in df.schema.fields:
        text = col(field.name).cast("string")
        if not (is_numeric(field.dataType) or isinstance(field.dataType, T.BooleanType)):
            text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            odd = F.isnan(col(field.name)) | (F.abs(col(field.name)) == float("inf"))
            text = F.when(odd, F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)
        cells.append(F.coalesce(text, F.lit("NULL")))
    return df.select(F.concat(F.lit(f'INSERT INTO "{table}" VALUES ('), F.concat_ws(", ", *cells), F.lit(");"))
                     .alias("value"))


def write_sql_dump(df: DataFrame, path: str, table: str) -> None:
    """``<path>/schema`` holds the CREATE statement, ``<path>/rows`` the INSERTs; read ``<path>/*``."""
    spark = df.sparkSession
    spark.createDataFrame([(create_statement(df, check_table_name(table)),)], "value string").coalesce(1).write.text(
        f"{path}/schema")
    sql_dump_rows(df, table).write.text(f"{path}/rows")

"""ZIP archives of CSV files, read member by member."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..naming import check_table_name, free_table_name
from .csv import column_names, raw_cell

LINES_PER_BATCH = 20_000
LINE = "number long, line string"


def _opened(path: str):
    """A file that is read from any place on, not as a whole, wherever Arrow can reach it."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return files.open_input_file(name)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Top-level CSV files of each archive with their first lines; folders and other files are ignored.

    An archive's directory stands at its end; only that and the beginnings of members are read.
    """
    rows: list[tuple] = []
    for batch in batches:
        for path in batch["path"].to_pylist():
            with _opened(path) as file, zipfile.ZipFile(file) as archive:
                for info in archive.infolist():
                    if info.filename.endswith(".csv") and "/" not in info.filename:
                        with archive.open(info) as member:
                            first = io.TextIOWrapper(member, encoding="utf-8").readline()
                        rows.append((path, info.filename, first, info.file_size))
    columns = list(zip(*rows)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))],
        names=["path", "member", "first", "size"])


def _lines(members: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads one member per partition: its bytes alone, unpacked as they come."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        path, name = members[TaskContext.get().partitionId()]
        with _opened(path) as file, zipfile.ZipFile(file) as archive, archive.open(name) as member:
            held, start = [], 0
            for line in io.TextIOWrapper(member, encoding="utf-8", newline="\n"):
                held.append(line.rstrip("\r\n"))
                if len(held) == LINES_PER_BATCH:
                    yield _batch(held, start)
                    start, held = start + len(held), []
            if held:
                yield _batch(held, start)

    return lines


def _batch(lines: list[str], start: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(start, start + len(lines)), pa.int64()), pa.array(lines, pa.string())],
                                      names=["number", "line"])


def csv_members(spark: SparkSession, path: str) -> list:
    """``(path, member, first, size)`` of the CSV files of an archive or of many, found in parallel; ``path`` may be a pattern."""
    archives = spark.read.format("binaryFile").load(path).select("path")
    return sorted(archives.mapInArrow(_headers, "path string, member string, first string, size long").collect(),
                  key=lambda row: (row["path"], row["member"]))


def read_csv_members(spark: SparkSession, members: list, header: bool = True) -> DataFrame:
    """Members with the same columns as one raw table: a partition per member."""
    names = column_names(members[0]["first"], header)
    if any(column_names(member["first"], header) != names for member in members):
        raise ValueError("the files of the archives have different columns")
    listed = [(member["path"], member["member"]) for member in members]
    lines = spark.range(0, len(listed), 1, len(listed)).mapInArrow(_lines(listed), LINE).where(F.col("line") != "")
    if header:
        lines = lines.where("number > 0")
    cells = F.split("line", ",", -1)
    checked = F.when(F.size(cells) == len(names), cells).otherwise(F.raise_error(
        F.lit(f"a row of {listed[0][1]} has not {len(names)} columns")).cast("array<string>"))
    return lines.select(checked.alias("cells")).select(*[raw_cell(F.col("cells")[i]).alias(n) for i, n in enumerate(names)])


def read_csv_archive(spark: SparkSession, path: str, header: bool = True) -> dict[str, DataFrame]:
    """One raw table per CSV file of the archive (or archives: ``path`` may be a pattern).

    Archives are never read as a whole, so they can be of any size: their directories are read from their ends, and a
    member is read by the task that needs it, by its place in the file, and unpacked in batches of lines. A packed file
    can only be read from its beginning on, by one task; archives of many members are read by many. Only the first line of
    each file comes to the driver. Files are opened through Arrow, in tasks, so its file systems have to know the path.
    """
    tables: dict[str, DataFrame] = {}
    for member in csv_members(spark, path):
        table = free_table_name(tables, check_table_name(member["member"].removesuffix(".csv")))
        tables[table] = read_csv_members(spark, [member], header)
    return tables

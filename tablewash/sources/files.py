"""Reading a file by its extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..naming import check_table_name
from ..types import EmptyFileError, InvalidFileExtensionError
from .archive import read_csv_archive
from .csv import read_csv_raw, read_csv_typed
from .dump import read_sql_dump


def read_file(spark: SparkSession, path: str, header: bool = True, infer_types: bool = False) -> dict[str, DataFrame]:
    """Tables of a ``.csv``, ``.zip``, ``.dump`` or ``.sql`` file."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, _, extension = name.rpartition(".")
    if extension not in ("csv", "zip", "dump", "sql"):
        raise InvalidFileExtensionError(name)
    if not spark.read.format("binaryFile").load(path).select("length").where("length > 0").take(1):
        raise EmptyFileError(path)
    if extension == "csv":
        read = read_csv_typed if infer_types else read_csv_raw
        return {check_table_name(stem): read(spark, path, header)}
    if extension == "zip":
        return read_csv_archive(spark, path, header)
    return read_sql_dump(spark, path)

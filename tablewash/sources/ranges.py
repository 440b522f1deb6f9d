"""Text files read by byte ranges, where the meaning of a range depends on what stands before it.

A task sees one range and cannot know whether it begins inside a text. So a first pass asks each range what it
would lead to from any beginning; these answers, a few values for each range, are composed in the order of
the file on the driver, which lists the ranges of the files anyway; and a second pass cuts each range knowing how
it begins. What begins in one range and ends in another leaves both as fragments, which are put together by
their owner, the range in which they began.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Times the passes are repeated if the cluster changes in between and files are cut at other places.
TRIES = 4
CHANGED = "files were cut into other ranges than before"


def read_ranges(spark: SparkSession, path: str, end: str) -> DataFrame:
    """``(value, file, start)``: records that end by ``end``, in order within each range; ranges by file and first byte."""
    return spark.read.option("lineSep", end).text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def by_range(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """``(file, start, values)`` of neighbouring records of one range; a range may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = (batch[name].to_numpy(zero_copy_only=False) for name in ("file", "start"))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield int(file[a]), int(start[a]), batch["value"].slice(a, b - a)


def in_order(answers: DataFrame) -> dict[int, list]:
    """One list of rows per file, by the first byte of their range."""
    files: dict[int, list] = {}
    for row in answers.collect():
        files.setdefault(row["file"], []).append(row)
    return {file: sorted(rows, key=lambda row: row["start"]) for file, rows in files.items()}


def whole(cut: DataFrame, columns: Iterable[str], text: str, between: str) -> DataFrame:
    """Pieces of a second pass with fragments put together: ``columns`` and ``text``.

    ``cut`` has ``file, owner, place`` beside them; pieces without an owner are whole. The fragments of a piece are
    joined by ``between``; a group holds one piece.
    """
    columns = list(columns)
    parts = F.array_sort(F.collect_list(F.struct("place", text)))
    joined = (cut.where("owner is not null").groupBy("file", "owner")
              .agg(*[F.first(c).alias(c) for c in columns],
                   F.array_join(F.transform(parts, lambda p: p[text]), between).alias(text)))
    return cut.where("owner is null").select(*columns, text).unionByName(joined.select(*columns, text))


def twice(passes: Callable[[], object]):
    """Run both passes, again from the beginning if files were cut differently in the second one."""
    for _ in range(TRIES - 1):
        try:
            return passes()
        except Exception as failure:
            if CHANGED not in str(failure):
                raise
    return passes()

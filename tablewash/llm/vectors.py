"""What searches over vectors share: clean rows, matrices, and the best of many scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows a search looks at to learn about all rows; a fixed bound.
SAMPLE = 2048


def clean_vectors(table: DataFrame, nonzero: bool = False) -> DataFrame:
    """``(vec_id, embedding)`` with one row per id and only finite components, at least one of them other than 0 if wanted.

    Rows without an id take no part; of rows that repeat an id the smallest vector counts.
    """
    plain = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        plain, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        fine &= F.exists(plain, lambda x: x != 0)
    return (table.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def some_rows(vectors: DataFrame, count: int) -> DataFrame:
    """The ``count`` rows whose ids have the smallest hashes: the same rows at every run."""
    return vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count)


def matrix(raw: Iterable[bytes], kind: str = "<f8") -> np.ndarray:
    """Rows of numbers from their bytes; shorter rows are filled up with 0, which changes no inner product."""
    rows = [np.frombuffer(x, dtype=kind) for x in raw]
    width = max((len(row) for row in rows), default=0)
    if all(len(row) == width for row in rows):
        return np.array(rows).reshape(len(rows), width)
    whole = np.zeros((len(rows), width), dtype=kind)
    for place, row in enumerate(rows):
        whole[place, :len(row)] = row
    return whole


def same_width(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(one.shape[1], other.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (one, other))


def with_bytes(vectors: DataFrame, numbers: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``vectors`` with ``numbers`` of each embedding as bytes in ``raw``, beside ``vec_id``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = numbers(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            rows = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(rows, pa.binary())], names=["vec_id", "raw"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(packed, "vec_id long, raw binary")


class Best:
    """The ``k`` highest scores of each query, ties to the smaller id; a pair counts once."""

    def __init__(self, queries: int, k: int, floor: np.ndarray, kind=np.int64):
        self.k = k
        self.low = -np.inf if kind == np.float64 else np.iinfo(np.int64).min
        self.floor = floor.astype(kind)
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=kind)
        self.id = np.zeros(0, dtype=np.int64)
        self.worst = self.floor.copy()

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids = np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        new = np.ones(len(query), dtype=bool)
        new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        query, score, ids = query[new], score[new], ids[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.score, self.id = query[kept], score[kept], ids[kept]
        full = rank == self.k - 1
        self.worst[query[full]] = np.maximum(self.floor[query[full]], score[full])


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best distinct rows of each query, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

"""Nearest neighbours by inner product with cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .vectors import Best, best_rows, clean_vectors, matrix, same_width, some_rows, with_bytes

TABLES = 8
# Queries whose true neighbours the number of probes is fitted on, and the share of them that must be found.
FIT_QUERIES = 128
RECALL = 0.96
# A bucket with more than twice the mean, and more rows than the first, is cut; one with more than the second always.
PIECE = (1024, 65_536)
# With more rows than so many per bucket, two rotations make one hash.
CROWDED = 65_536


@dataclass
class CrossPolytope:
    """Hash tables over unit vectors: in each, the signed axes nearest to the vector after ``functions`` rotations."""

    width: int
    tables: int = TABLES
    functions: int = 1
    seed: int = 7

    def __post_init__(self):
        self.padded = 1 << max(0, self.width - 1).bit_length()
        self.axes = 2 * self.padded
        self.buckets = self.axes ** self.functions

    def rotated(self, points: np.ndarray, table: int, function: int) -> np.ndarray:
        """A pseudo-random rotation: three times random signs and then a fast Hadamard transform."""
        out = np.zeros((len(points), self.padded))
        out[:, :points.shape[1]] = points
        for turn in range(3):
            signs = np.random.default_rng([self.seed, table, function, turn]).integers(0, 2, self.padded) * 2 - 1
            out = _hadamard(out * signs)
        return out

    def _axis_scores(self, points: np.ndarray, table: int, function: int) -> np.ndarray:
        """How near each signed axis is: column ``2 * axis`` is the negative one, the next the positive."""
        turned = self.rotated(points, table, function)
        return np.stack([-turned, turned], axis=2).reshape(len(points), self.axes)

    def bucket(self, points: np.ndarray, table: int) -> np.ndarray:
        number = np.zeros(len(points), dtype=np.int64)
        for function in range(self.functions):
            number = number * self.axes + self._axis_scores(points, table, function).argmax(axis=1)
        return number

    def scores(self, points: np.ndarray, table: int) -> np.ndarray:
        """How promising each bucket is for each point: the sum over its axes."""
        total = np.zeros((len(points), 1))
        for function in range(self.functions):
            axes = self._axis_scores(points, table, function)
            total = (total[:, :, None] + axes[:, None, :]).reshape(len(points), -1)
        return total

    def probes(self, points: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` most promising buckets of each point."""
        chosen = []
        for at in range(0, len(points), 64):
            scores = -self.scores(points[at:at + 64], table)
            chosen.append(np.argpartition(scores, min(count, self.buckets) - 1, axis=1)[:, :count])
        return np.concatenate(chosen) if chosen else np.zeros((0, count), dtype=np.int64)


def _hadamard(rows: np.ndarray) -> np.ndarray:
    size = rows.shape[1]
    half = 1
    while half < size:
        pairs = rows.reshape(len(rows), -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), size)
        half *= 2
    return rows / np.sqrt(size)


def _unit(points: np.ndarray) -> np.ndarray:
    # Scaled first, so that very small or large components do not vanish or overflow.
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _offer(best: Best, rows: np.ndarray, asked: np.ndarray, query_ids: np.ndarray, points: np.ndarray,
           ids: np.ndarray) -> None:
    """Put in ``best`` what beats it: chosen by one matrix product, then scored pair by pair.

    A matrix product may round equal vectors differently; the scores that count are summed in one order.
    """
    rough = asked @ points.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    least = best.worst[rows]
    if len(ids) > best.k:
        least = np.maximum(least, np.partition(rough, len(ids) - best.k, axis=1)[:, len(ids) - best.k])
    slack = 1e-9 * np.linalg.norm(asked, axis=1) * np.linalg.norm(points, axis=1).max(initial=0)
    row, column = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
    for at in range(0, len(row), 1 << 18):
        r, c = row[at:at + (1 << 18)], column[at:at + (1 << 18)]
        best.add(rows[r], np.einsum("ij,ij->i", asked[r], points[c]), ids[c])


def _best(asked: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> Best:
    asked, points = same_width(asked, points)
    best = Best(len(query_ids), k, floor, np.float64)
    for at in range(0, len(query_ids), 256):
        rows = np.arange(at, min(len(query_ids), at + 256))
        for begin in range(0, len(ids), 8192):
            _offer(best, rows, asked[rows], query_ids[rows], points[begin:begin + 8192], ids[begin:begin + 8192])
    return best


def _points(column) -> np.ndarray:
    return matrix([bytes(raw) for raw in column])


def true_neighbours(vectors: DataFrame, asked: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """``(query_id, vec_id, score, raw, rank)`` of the ``k`` nearest rows of a bounded number of queries, by brute force."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            best = _best(asked, query_ids, np.full(len(query_ids), -np.inf), _points(batch["raw"].to_pylist()), ids, k)
            order = np.argsort(ids, kind="stable")
            place = order[np.searchsorted(ids[order], best.id)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[best.query]), pa.array(best.id), pa.array(best.score),
                 batch["raw"].take(pa.array(place))], names=["query_id", "vec_id", "score", "raw"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (vectors.mapInArrow(scored, "query_id long, vec_id long, score double, raw binary")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def fit_probes(vectors: DataFrame, queries: DataFrame, index: CrossPolytope, k: int, recall: float = RECALL) -> int:
    """Buckets per table to look into, so that ``recall`` of the true neighbours of some queries are met.

    The true neighbours among all rows are found by brute force for ``FIT_QUERIES`` queries; this measures
    the recall of the index as it is, and the smallest sufficient number of probes is taken.
    """
    some = some_rows(queries, FIT_QUERIES).collect()
    if not some:
        return 1
    ids = np.array([r.vec_id for r in some], dtype=np.int64)
    points = _points([r.raw for r in some])
    near = true_neighbours(vectors, points, ids, k).collect()
    if not near:
        return 1
    place = {vec_id: n for n, vec_id in enumerate(ids.tolist())}
    row = np.array([place[r.query_id] for r in near])
    asked, found = same_width(_unit(points), _unit(_points([r.raw for r in near])))
    needed = np.full(len(near), index.buckets)
    for table in range(index.tables):
        bucket = index.bucket(found, table)
        for n in range(len(ids)):
            mine = row == n
            scores = index.scores(asked[n:n + 1], table)[0]
            needed[mine] = np.minimum(needed[mine], (scores[None, :] > scores[bucket[mine]][:, None]).sum(axis=1) + 1)
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def nearest(table: DataFrame, queries: Column, k: int = 20, tables: int = TABLES, recall: float = RECALL,
            functions: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row chosen by ``queries`` the ``k`` nearest rows found.

    ``table(vec_id, embedding)``; nearness is the inner product of the vectors as they are, in double precision. Rows
    with null, zero, or null or non-finite components take no part; ties go to the smaller id; a query's own row
    is no candidate. Every row stands in one bucket of each table, by its direction. The number of buckets a
    query looks into is fitted to the wanted recall; candidates are scored exactly. A bucket that is far larger than the
    mean is cut, and queries look into all its parts. Queries that meet fewer than ``k`` rows look into all buckets.
    """
    vectors = checkpoint(with_bytes(clean_vectors(table, nonzero=True), lambda x: x))
    asked = vectors.where(queries)
    rows, longest = vectors.agg(F.count(F.lit(1)), F.max(F.octet_length("raw"))).first()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = longest // 8
    if functions is None:
        functions = 1 if rows <= CROWDED * CrossPolytope(width).axes else 2
    index = CrossPolytope(width, tables, functions)
    probes = fit_probes(vectors, asked, index, k, recall)
    found = checkpoint(_probe(vectors, asked, index, probes, k))
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, rows - 1))
    short = checkpoint(asked.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return found
    again = _probe(vectors, short, index, index.buckets, k)
    return found.join(enough, "query_id", "left_semi").unionByName(again)


def _probe(vectors: DataFrame, asked: DataFrame, index: CrossPolytope, probes: int, k: int) -> DataFrame:
    spark = vectors.sparkSession
    # Looking into all buckets needs one table only.
    tables = range(1 if probes >= index.buckets else index.tables)
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _unit(_points(batch["raw"].to_pylist()))
            bucket = np.stack([index.bucket(points, table) for table in tables], axis=1)
            yield batch.append_column("places", pa.array(list(bucket), pa.list_(pa.int64())))

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _unit(_points(batch["raw"].to_pylist()))
            chosen = np.stack([index.probes(points, table, probes) for table in tables], axis=1)
            yield batch.append_column("places", pa.array(chosen.tolist(), pa.list_(pa.list_(pa.int64()))))

    rows = (vectors.mapInArrow(placed, "vec_id long, raw binary, places array<long>")
            .select("vec_id", "raw", F.posexplode("places").alias("table", "bucket")))
    looks = (asked.mapInArrow(looked, "vec_id long, raw binary, places array<array<long>>")
             .select("vec_id", "raw", F.posexplode("places").alias("table", "chosen"))
             .select("vec_id", "raw", "table", F.explode("chosen").alias("bucket")))
    counts = checkpoint(rows.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")))
    mean = counts.agg(F.avg("n")).first()[0]
    size = int(min(PIECE[1], max(PIECE[0], 2 * mean)))
    # At most half of all buckets can hold more than twice the mean, whose number is fixed by the index.
    cut = [(r["table"], r.bucket, -(-r.n // size)) for r in counts.where(F.col("n") > size).collect()]
    cut = F.broadcast(spark.createDataFrame(cut, "table int, bucket long, parts int"))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    rows = (rows.join(cut, ["table", "bucket"], "left")
            .select("table", "bucket", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), "vec_id", "raw"))
    looks = (looks.join(cut, ["table", "bucket"], "left")
             .select("table", "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "vec_id", "raw"))

    def searched(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})
        query_ids = left["vec_id"].to_numpy()
        # The k best of a group leave it, so that what travels grows with the queries and not with the rows.
        best = _best(_points(left["raw"]), query_ids, np.full(len(left), -np.inf), _points(right["raw"]),
                     right["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": query_ids[best.query], "vec_id": best.id, "score": best.score})

    key = ["table", "bucket", "part"]
    found = (looks.groupBy(*key).cogroup(rows.groupBy(*key))
             .applyInPandas(searched, "query_id long, vec_id long, score double"))
    return best_rows(found, k)

"""Whitening of integer vectors by principal components, refined from single to double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

SCALE = 256
COMPONENTS = 4
# Rows that a task turns into a matrix at a time.
ROWS = 8192
LARGEST = np.iinfo(np.int64).max


def refine(matrix: np.ndarray, vectors: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of a symmetric matrix from approximate eigenvectors, by falling value.

    One round is four products of matrices: how far the vectors X are from orthogonal, R = I - X'X, and from diagonal,
    S = X'AX, gives the correction X + XE with

        E[i, j] = (S[i, j] + l[j] R[i, j]) / (l[j] - l[i])

    for values l that lie apart, and half of R within a cluster, where the quotient says nothing. Errors are squared
    in each round. Vectors of a cluster then span the right space but are mixed within it: its small matrix, shifted
    by the cluster's middle so that the differences fill the digits, is solved on its own and the vectors are turned.
    """
    a = np.asarray(matrix, dtype=np.float64)
    size = len(a)
    if not size:
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(a).max()
    if not scale:
        return np.zeros(size), np.eye(size)
    a = a / scale
    x = np.asarray(vectors, dtype=np.float64)
    unit = np.finfo(np.float64).eps
    norm, one, best = np.linalg.norm(a), np.eye(size), np.inf
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ a @ x
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        wide = 2 * (np.linalg.norm(off - np.diag(np.diag(off))) + norm * np.linalg.norm(r))
        gaps = values[None, :] - values[:, None]
        near = np.abs(gaps) <= max(wide, 4 * unit * norm)
        np.fill_diagonal(near, True)
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gaps))
        x = x + x @ e
        for group in _clusters(values, near):
            x[:, group] = _within(a, x[:, group])
        change = np.abs(e).max()
        # Corrections are squared until they reach the last digits, and then stop falling.
        if change <= 8 * unit or (change >= best and change < 1e-12):
            break
        best = min(best, change)
    # What quotients of close values left of angles between vectors.
    x = x + x @ (one - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _clusters(values: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
    """Groups of two and more values that hang together by being near, neighbour by neighbour."""
    order = np.argsort(values, kind="stable")
    joined = near[order[:-1], order[1:]]
    return [group for group in np.split(order, np.flatnonzero(~joined) + 1) if len(group) > 1]


def _within(a: np.ndarray, space: np.ndarray) -> np.ndarray:
    """An orthogonal basis of the same space whose vectors diagonalise ``a`` within it."""
    basis, _ = np.linalg.qr(space)
    middle = np.einsum("ij,ij->", basis, a @ basis) / basis.shape[1]
    small = basis.T @ (a @ basis - middle * basis)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return basis @ turn


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors to double precision, by falling value: solved in single precision, then refined."""
    scale = np.abs(matrix).max() if matrix.size else 0.0
    start = np.linalg.eigh((matrix / scale).astype(np.float32))[1] if scale else np.eye(len(matrix))
    return refine(matrix, start)


def _shortest(numbers: np.ndarray) -> bytes:
    """The one way to write a vector down: without zeros at the end, in the narrowest width; the first byte is the width."""
    size = int(np.flatnonzero(numbers)[-1]) + 1 if numbers.any() else 0
    numbers = numbers[:size]
    low, high = (int(numbers.min()), int(numbers.max())) if size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + numbers.astype(f"<i{width}").tobytes()


def _long(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).astype(np.int64)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``ROWS`` rows with their vectors as a matrix of longs."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            rows = np.zeros((part.num_rows, width), dtype=np.int64)
            for place, raw in enumerate(part["x"].to_pylist()):
                numbers = _long(raw)
                rows[place, :len(numbers)] = numbers
            yield part, rows


def whole_numbers(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x, width)`` of each row whose vector is there and holds only finite entries; x is ``floor(scale * entry)``.

    ``x`` is written as bytes, equal for equal vectors. Shorter vectors count as filled up with 0; entries beyond the
    range of a long stand at its end.
    """

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            top = float(1 << 63)
            inside = np.where(np.abs(flat) < top, flat, 0).astype(np.int64)
            inside[flat >= top], inside[flat <= -top] = LARGEST, -LARGEST - 1
            raws = [_shortest(inside[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(raws, pa.binary()), pa.array(np.diff(ends), pa.int32())],
                names=["vec_id", "x", "width"])

    plain = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(
        plain, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return (table.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("embedding"))
            .mapInArrow(turned, "vec_id long, x binary, width int"))


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for _, rows in _matrices(batches, width):
            count += len(rows)
            # Halves of 32 bits, which no number of rows of a task can make overflow.
            high += (rows >> 32).sum(axis=0)
            low += (rows & 0xFFFFFFFF).sum(axis=0)
        if count:
            place = pa.array(np.arange(width + 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [place, pa.array([*high.tolist(), 0]), pa.array([*low.tolist(), count])], names=["place", "high", "low"])

    rows = (fit.mapInArrow(partial, "place int, high long, low long").groupBy("place")
            .agg(F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)"))).collect())
    total = {place: (int(high) << 32) + int(low) for place, high, low in rows}
    return total.get(width, 0), [total.get(n, 0) for n in range(width)]


def _mean(sums: list[int], count: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean in a whole and a broken part, so that subtracting it from a long loses nothing."""
    return (np.array([s // count for s in sums], dtype=np.int64),
            np.array([s % count / count for s in sums], dtype=np.float64))


def _centred(rows: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    whole, broken = mean
    if len(rows) and max(np.abs(rows).max(), np.abs(whole).max()) >= 1 << 62:
        return rows.astype(np.float64) - whole.astype(np.float64) - broken
    return (rows - whole).astype(np.float64) - broken


def _covariance(fit: DataFrame, width: int, count: int, mean: tuple, turn: np.ndarray | None = None) -> np.ndarray:
    """Mean product of centred dimensions, or of their projections on the columns of ``turn``, added up by Spark.

    Projections are centred a second time, by their own mean.
    """
    size = width if turn is None else turn.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((size, size)), np.zeros(size)
        for _, rows in _matrices(batches, width):
            centred = _centred(rows, mean)
            if turn is not None:
                centred = centred @ turn
            products += centred.T @ centred
            sums += centred.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size + 1), pa.int32()),
             pa.array([row.tobytes() for row in [*products, sums]], pa.binary())], names=["place", "raw"])

    def added(frame):
        # In one order at every run: tasks may end in any.
        rows = np.sort(np.array([np.frombuffer(raw) for raw in frame["raw"]]).reshape(len(frame), size), axis=0)
        return frame.iloc[:1].assign(raw=[rows.sum(axis=0).tobytes()])[["place", "raw"]]

    rows = (fit.mapInArrow(partial, "place int, raw binary").groupBy("place")
            .applyInPandas(added, "place int, raw binary").collect())
    found = {row["place"]: np.frombuffer(row["raw"]) for row in rows}
    result = np.array([found[n] for n in range(size)]) / count
    rest = found[size] / count  # what rounding left of the mean
    result = result - np.outer(rest, rest)
    return (result + result.T) / 2


def whiten(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitened coordinates of ``table(vec_id, embedding)``: one row per vector and component.

    The model is fitted on each distinct vector once: count, sums, and in a second pass the covariance of centred
    vectors, added up from the tasks' matrices. Only numbers per dimension and per pair of dimensions reach the driver,
    where ``eigen`` solves for the components; a third pass measures how far the whitened fit list is from the identity.

    Columns: ``vec_id``, ``component`` (from 1), ``n`` (distinct vectors), ``deviation`` (sum over dimensions of
    (n x - S)^2, exact; null where it is no long), ``whitened``, ``explained``, ``identity_error``. Rows with null, NaN or
    infinite entries take no part; null and repeated ids are rows like others; equal vectors count once in the fit. A
    component without variance gives ``whitened`` 0 and is left out of ``identity_error``. Fewer dimensions than ``components``
    give fewer components, no rows give none. Other columns are left behind.
    """
    rows = whole_numbers(table, scale)
    # Equal vectors become one before the shuffle already, so many copies of a vector are no hot key.
    fit = checkpoint(rows.groupBy("x").agg(F.max("width").alias("width")))
    width = fit.agg(F.max("width")).first()[0] or 0
    kinds = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")
    if not width:
        return table.sparkSession.createDataFrame([], kinds)
    count, sums = _sums(fit, width)
    mean = _mean(sums, count)
    covariance = _covariance(fit, width, count, mean)
    values, vectors = eigen(covariance)
    trace = float(np.trace(covariance))
    wanted = min(components, width)
    values, vectors = values[:wanted], vectors[:, :wanted]
    alive = values > trace * 1e-14
    turn = np.where(alive, vectors / np.sqrt(np.where(alive, values, 1)), 0)
    explained = np.where(alive, values / trace, 0.0) if trace else np.zeros(wanted)
    error = 0.0
    if alive.any():
        error = float(np.abs(_covariance(fit, width, count, mean, turn[:, alive]) - np.eye(int(alive.sum()))).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, numbers in _matrices(batches, width):
            found = _centred(numbers, mean) @ turn
            spread = pa.array(_deviation(numbers, count, sums), pa.int64())
            place = pa.array(np.repeat(np.arange(batch.num_rows), wanted))
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(place), pa.array(np.tile(np.arange(1, wanted + 1), size), pa.int32()),
                 pa.array(np.full(size * wanted, count), pa.int64()), spread.take(place), pa.array(found.ravel()),
                 pa.array(np.tile(explained, size)), pa.array(np.full(size * wanted, error))],
                names=[field.split()[0] for field in kinds.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(projected, kinds)


def _deviation(rows: np.ndarray, count: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(count * x - sums)^2`` for each row, exact, or none where it is beyond a long."""
    if not len(rows):
        return []
    far = max((max(abs(int(rows[:, n].min()) * count - s), abs(int(rows[:, n].max()) * count - s))
               for n, s in enumerate(sums)), default=0)
    if far * far * len(sums) <= LARGEST and max(abs(int(rows.min())), abs(int(rows.max()))) * count <= LARGEST:
        return ((rows * count - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    totals = [sum((int(x) * count - s) ** 2 for x, s in zip(row, sums)) for row in rows]
    return [total if total <= LARGEST else None for total in totals]

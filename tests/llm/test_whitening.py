import numpy as np
import pytest

import helpers
from pyspark.sql import functions as F
from tablewash.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, wanted=4):
    """The whole result in numpy, with LAPACK's solver in double precision."""
    kept = [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    fit = np.array(sorted({tuple(v) for _, v in kept}), dtype=np.float64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    result = {}
    for i, v in kept:
        white = (np.array(v) - sums / n) @ vectors / np.sqrt(np.where(values > 1e-12, values, np.inf))
        deviation = sum((n * x - int(s)) ** 2 for x, s in zip(v, sums))
        result.setdefault(i, []).append((n, deviation, white, values / np.trace(covariance)))
    return result


def check(found, want, close=1e-9):
    by_row = {}
    for row in found:
        by_row.setdefault(row["vec_id"], []).append(row)
    assert set(by_row) == set(want)
    signs = None
    for i, rows in by_row.items():
        assert len(rows) == 4 * len(want[i])
        if len(want[i]) > 1:
            continue
        rows.sort(key=lambda r: r["component"])
        n, deviation, white, explained = want[i][0]
        assert [r["component"] for r in rows] == [1, 2, 3, 4]
        assert {r["n"] for r in rows} == {n} and {r["deviation"] for r in rows} == {deviation}
        mine = np.array([r["whitened"] for r in rows])
        if signs is None and (np.abs(white) > 1e-3).all():
            signs = np.sign(mine * white)
        if signs is not None:
            assert np.abs(mine - signs * white).max() < close
        assert np.abs(np.array([r["explained"] for r in rows]) - explained).max() < 1e-9
        assert all(r["identity_error"] < 1e-9 for r in rows)


def test_query_against_lapack(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.QUERIES["op12_whitening"](spark, folder).collect(), plain(rows))


def test_copies_gaps_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in rng.normal(0, [3, 2, 1.5, 1, 0.5], 5).astype(np.float32)]) for n in range(300)]
    rows += [(1000 + n, rows[0][1]) for n in range(200)]  # many copies count once
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [float("inf")] * 5),
             (2004, [1.0, 2.0]), (2005, []), (None, [1.0] * 5), (7, [2.0] * 5), (7, [2.0] * 5)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    table = helpers.clashing(table).withColumn("x", F.lit("own")).withColumn("component", F.lit("own"))
    check(whitening.whiten(table).collect(), plain(rows))


def test_little_to_whiten(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()

    assert run([]) == [] and run([(1, None), (2, [])]) == []
    one = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(one) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) ==
                                 (1, 0, 0.0, 0.0, 0.0) for r in one)
    line = run([(n, [float(n), 2.0 * n, 0.0]) for n in range(5)])
    assert len(line) == 15 and all(r["whitened"] == 0 for r in line if r["component"] > 1)
    assert sum(r["whitened"] ** 2 for r in line if r["component"] == 1) == pytest.approx(5)
    assert all(r["explained"] == pytest.approx(float(r["component"] == 1)) for r in line)
    huge = run([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])
    assert len(huge) == 6 and {r["vec_id"]: r["deviation"] for r in huge} == {
        1: None, 2: None, 3: 1 + (3 * 768 - 6 * 256) ** 2}
    wide = run([(n, [1e6 * n, float(n)]) for n in range(40)])
    assert {r["vec_id"]: r["deviation"] for r in wide if r["component"] == 1} == {
        n: sum((40 * x - 39 * 20 * y) ** 2 for x, y in ((256 * 10 ** 6 * n, 256 * 10 ** 6), (256 * n, 256)))
        if sum((40 * x - 39 * 20 * y) ** 2 for x, y in ((256 * 10 ** 6 * n, 256 * 10 ** 6), (256 * n, 256))) < 2 ** 63
        else None for n in range(40)}


def symmetric(values, seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    return (q * values) @ q.T, q


@pytest.mark.parametrize("values", [
    np.arange(40, 0, -1.0), np.r_[5, 5, 5, 2, 1, 1], np.r_[1 + 1e-9 * np.arange(10), 3], np.ones(7),
    np.r_[1e8, 1 + 1e-7 * np.arange(30), 1e-6], np.zeros(3), np.r_[4.0], np.r_[2, 2 - 1e-6, 2 - 2e-6, 1, 1 - 1e-12]])
def test_refined_to_double_precision(values):
    matrix, _ = symmetric(values, 3)
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.eigen(matrix)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * scale * len(values)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * scale * len(values)


def test_rounds_square_the_error():
    """From single precision on, well separated vectors are right to the last digits after two rounds."""
    matrix, _ = symmetric(np.arange(60, 0, -1.0), 5)
    matrix = (matrix + matrix.T) / 2
    _, exact = np.linalg.eigh(matrix)
    exact = exact[:, ::-1]
    start = np.linalg.eigh(matrix.astype(np.float32))[1].astype(np.float64)

    def error(vectors):
        return np.abs(np.abs(np.einsum("ij,ij->j", vectors, exact)) - 1).max(), np.abs(
            vectors - exact * np.sign(np.einsum("ij,ij->j", vectors, exact))).max()

    assert error(start[:, ::-1])[1] > 1e-7
    assert error(whitening.refine(matrix, start, rounds=2)[1])[1] < 1e-12

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewash.llm import crosspolytope as cp


def sphere(count, width, seed=0):
    raw = np.random.default_rng(seed).normal(size=(count, width))
    return raw / np.linalg.norm(raw, axis=1)[:, None]


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_rotations_keep_lengths_and_buckets_hold_the_nearest_axis(width):
    index = cp.CrossPolytope(width, tables=2)
    points = sphere(50, width)
    for table in range(2):
        turned = index.rotated(points, table, 0)
        assert np.allclose(np.linalg.norm(turned, axis=1), 1)
        axes = np.concatenate([np.eye(index.padded), -np.eye(index.padded)])
        nearest = (turned @ axes.T).argmax(axis=1)
        assert (index.bucket(points, table) == 2 * (nearest % index.padded) + (nearest < index.padded)).all()


@pytest.mark.parametrize("functions", [1, 2])
def test_probes_begin_with_the_own_bucket(functions):
    index = cp.CrossPolytope(7, functions=functions)
    points = sphere(40, 7)
    scores, own = index.scores(points, 3), index.bucket(points, 3)
    # Sums of two scores can be equal after rounding.
    assert scores[np.arange(40), own] == pytest.approx(scores.max(axis=1))
    assert scores[np.arange(40), index.probes(points, 3, 1)[:, 0]] == pytest.approx(scores.max(axis=1))
    for row, chosen in zip(scores, index.probes(points, 3, 9)):
        assert sorted(row[chosen]) == pytest.approx(sorted(row)[-9:])
    assert index.probes(points, 3, index.buckets).shape == (40, index.buckets)


def brute(rows, divisor, k):
    kept = {}
    for vec_id, vector in rows:
        if (vec_id is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector)
                and any(vector)):
            kept[vec_id] = min(kept.get(vec_id, vector), vector)
    ids = np.array(sorted(kept))
    points = np.array([kept[i] for i in ids])
    out = {}
    for place, q in enumerate(ids):
        if q % divisor == 0:
            scores = np.einsum("j,ij->i", points[place], points)
            out[int(q)] = sorted((-s, int(i)) for s, i in zip(scores, ids) if i != q)[:k]
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) <= set(want)
    hits = 0
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        exact = {i: -s for s, i in best}
        assert all(m[2] == pytest.approx(exact[m[1]], abs=1e-12) for m in mine if m[1] in exact)
        hits += len({m[1] for m in mine} & set(exact))
    return hits / max(1, sum(len(b) for b in want.values()))


@pytest.mark.parametrize("functions", [None, 2])
def test_recall_on_uniform_and_clustered_vectors(spark, functions, monkeypatch):
    monkeypatch.setattr(cp, "PIECE", (64, 128))
    rng = np.random.default_rng(3)
    points = np.concatenate([sphere(1200, 12, 5), sphere(6, 12, 6)[rng.integers(0, 6, 800)]
                             + rng.normal(size=(800, 12)) * 0.02])
    rows = [(n, [float(x) for x in p]) for n, p in enumerate(points)]
    rows += [(5000 + n, rows[40][1]) for n in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    table = table.select("*", *[F.lit("own").alias(n) for n in helpers.CLASHES + ("raw", "places", "bucket", "table")])
    found = cp.nearest(table, F.col("vec_id") % 20 == 0, 20, functions=functions).collect()
    assert recall(found, brute(rows, 20, 20)) >= 0.93


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 0.0]), (40, None), (60, [None, 1.0]), (80, [float("nan"), 1.0]),
            (100, [-1.0, 0.0]), (None, [1.0, 1.0]), (2, [3.0e30, 1.0]), (3, [1.0e-30, 0.0]), (0, [1.0, 0.0])]
    for some in (rows, rows[:1], rows[:2], rows[2:6], []):
        found = cp.nearest(spark.createDataFrame(some, schema), F.col("vec_id") % 20 == 0, 20).collect()
        want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in some],
                     20, 20)
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == sorted(
            (q, rank, i) for q, best in want.items() for rank, (_, i) in enumerate(best, 1))


def test_registered_query(spark):
    from tablewash.llm import queries

    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, [float(x) for x in r.embedding])
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert recall(queries.op10_crosspolytope(spark, folder).collect(), brute(rows, 20, 20)) >= 0.93

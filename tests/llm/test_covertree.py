import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewash.llm import covertree
from tablewash.llm.vectors import Best

LOW = np.iinfo(np.int64).min


def points(kind, count, width, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "sphere":
        raw = rng.normal(size=(count, width))
        return np.floor(256 * raw / np.linalg.norm(raw, axis=1)[:, None])
    if kind == "clusters":
        return np.floor(rng.normal(size=(8, width))[rng.integers(0, 8, count)] * 300 + rng.normal(size=(count, width)) * 9)
    if kind == "equal":
        return np.tile(rng.integers(-9, 9, width).astype(float), (count, 1))
    return rng.integers(-3, 4, (count, width)).astype(float)


KINDS = ["sphere", "clusters", "equal", "ties"]


@pytest.mark.parametrize("kind", KINDS)
def test_invariants(kind):
    data = points(kind, 600, 5)
    tree = covertree.CoverTree(data)
    held = set()
    for node, children in enumerate(tree.children):
        below = np.concatenate(tree.members[node])
        assert len(np.unique(below)) == len(below)
        for child, radius, members in zip(children, tree.radius[node], tree.members[node]):
            assert child in members
            assert np.linalg.norm(data[members] - data[child], axis=1).max() <= radius + 1e-9
        held |= set(below.tolist())
    assert held == set(range(600)) and len(np.concatenate(tree.members[0])) == 600


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("count, asked, width", [(700, 90, 12), (300, 300, 2), (3, 2, 4), (1, 1, 1)])
def test_dual_search_against_brute_force(kind, count, asked, width):
    data, queries = points(kind, count, width), points(kind, asked, width, 0 if kind == "clusters" else 1)
    rng = np.random.default_rng(2)
    ids, query_ids = rng.permutation(2 * count)[:count], rng.permutation(2 * count)[:asked]
    best = Best(asked, 5, np.full(asked, LOW))
    covertree.dual_search(covertree.CoverTree(queries), query_ids, covertree.CoverTree(data), ids, best)
    scores = (queries @ data.T).astype(int)
    for n in range(asked):
        want = sorted((-scores[n, m], ids[m]) for m in range(count) if ids[m] != query_ids[n])[:5]
        mine = best.query == n
        assert [(-s, i) for s, i in zip(best.score[mine], best.id[mine])] == want


def test_pruning_happens(monkeypatch):
    data = points("clusters", 2000, 6)
    seen = []
    add = Best.add
    monkeypatch.setattr(Best, "add", lambda self, q, s, i: (seen.append(len(q)), add(self, q, s, i))[1])
    best = Best(50, 3, np.full(50, LOW))
    covertree.dual_search(covertree.CoverTree(data[:50]), np.arange(50), covertree.CoverTree(data), np.arange(2000), best)
    assert sum(seen) < 0.2 * 50 * 2000


def brute(rows, divisor, k):
    kept = {}
    for vec_id, vector in rows:
        if vec_id is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            kept[vec_id] = min(kept.get(vec_id, vector), vector)
    whole = {i: np.floor(256 * np.array(v, dtype=float)).astype(int) for i, v in kept.items()}
    out = []
    for q in whole:
        if q % divisor == 0:
            scored = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def test_table_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(n, [float(x) for x in rng.normal(size=6)]) for n in range(900)]
    rows += [(2000 + n, rows[7][1]) for n in range(300)]
    rows += [(None, rows[3][1]), (50, None), (100, [None] + rows[1][1][1:]), (150, [float("nan")] * 6),
             (3000, [float("inf")] * 6), rows[7], rows[250], (250, [0.0] * 6)]
    rows = [r for r in rows if r[0] not in (50, 100, 150) or r[1] is None or None in r[1] or r[1][0] != r[1][0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    table = table.select("*", *[F.lit("own").alias(n) for n in helpers.CLASHES + ("raw", "anchor", "block", "floor")])
    monkeypatch.setattr(covertree, "BLOCK", (64, 128))
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 10)
    got = covertree.exact_top(table, F.col("vec_id") % 50 == 0, 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 50, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0])], [(0, []), (1, [])]):
        table = spark.createDataFrame(rows, schema)
        got = covertree.exact_top(table, F.col("vec_id") % 50 == 0, 5).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 50, 5)

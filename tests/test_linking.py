import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewash.dedup import candidates as cand
from tablewash.dedup import clusters as link
from tablewash.dedup import matching, segments
from tablewash.functions.similarity import Codebook, damerau_levenshtein
from tablewash.types import AttrTypeError, InvalidValueError


def distance(a, b):
    """Textbook form with the whole matrix."""
    last, far = {}, len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i, j - 1] + 1, d[i - 1, j] + 1,
                          d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def sim(a, b):
    if not a or not b:
        return 0.0
    return 1 - distance(a, b) / max(len(a), len(b))


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_distance():
    rand = random.Random(2)
    words = ["".join(rand.choice("abcé") for _ in range(rand.randrange(9))) for _ in range(600)] + ["a" * 300, "ba" * 90]
    pairs = [(rand.choice(words), rand.choice(words)) for _ in range(2000)] + [("ca", "abc"), ("Jonh", "John"), ("", "")]
    left, right = zip(*pairs)
    assert damerau_levenshtein(left, right).tolist() == [distance(a, b) for a, b in pairs]


def test_codebook():
    texts = ["Jonh", "John", "", "x"]
    rows = np.array([0, 1, 2, 3, -1, 0])
    book = Codebook(rows, texts)
    for pairs in (1, 15, 15):
        left, right = map(np.array, zip(*list(itertools.combinations(range(6), 2))[-pairs:]))
        values, where = book.similarities(left, right)
        want = [sim(*("" if rows[i] < 0 else texts[rows[i]] for i in pair)) for pair in zip(left, right)]
        assert values[where].tolist() == want


PEOPLE = [
    (10, "John", "Smith", 30, "NY"), (11, "Jonh", "Smith", 30, "NY"), (12, "John", "Smyth", 30, "NY"),
    (13, "Mary", "Jones", 41, "NY"), (14, "Mary", "Jones", 41, "NY"), (15, "Mari", "Jones", 41, "NY"),
    (16, None, "Jones", 41, "LA"), (17, None, "Jones", 41, "LA"), (18, "Zoe", "Xu", None, "LA"),
    (19, "Zoe", "Xu", None, None), (20, "Omar", "Li", 7, "LA"),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id long, first string, last string, age int, city string")


def expected(rows, pairs, columns, threshold):
    text = {r["id"]: [None if r[c] is None else str(r[c]) for c in columns] for r in rows}
    scored = [(a, b, sum(sim(x, y) for x, y in zip(text[a], text[b])) / len(columns)) for a, b in pairs]
    return components([(a, b) for a, b, s in scored if s >= threshold - 1e-9])


def rows_of(df):
    return {r["id"]: r["cluster_id"] for r in df.collect()}


@pytest.mark.parametrize("tile", [2, 1024])
@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 0.95])
def test_every_pair(people, monkeypatch, tile, threshold):
    monkeypatch.setattr(cand, "TILE", tile)
    rows = people.collect()
    pairs = list(itertools.combinations(sorted(r["id"] for r in rows), 2))
    want = expected(rows, pairs, ["first", "last", "age", "city"], threshold)
    assert rows_of(link.find_clusters(people, "id", threshold=threshold)) == want


@pytest.mark.parametrize("tile", [2, 1024])
def test_blocks(people, monkeypatch, tile):
    monkeypatch.setattr(cand, "TILE", tile)
    rows = people.collect()
    pairs = [(a["id"], b["id"]) for a, b in itertools.combinations(rows, 2)
             if a["city"] == b["city"] and a["city"] and a["age"] == b["age"] and a["age"] is not None]
    want = expected(rows, pairs, ["first", "last"], 0.5)
    got = link.find_clusters(people, "id", ["city", "age"], ignore=["city", "age"], threshold=0.5)
    assert rows_of(got) == want
    assert people.count() == 11 and cand.blocks(people, ["city", "age"]).agg(F.sum("pair_count")).first()[0] == len(pairs)


@pytest.mark.parametrize("tile", [3, 1024])
def test_neighbours(spark, monkeypatch, tile):
    monkeypatch.setattr(cand, "TILE", tile)
    rand = random.Random(4)
    # One key holds a third of all rows.
    data = [(i, 50 if rand.random() < 0.33 else rand.randrange(100),
             "".join(rand.choice("ab") for _ in range(rand.randrange(2, 5)))) for i in range(150)] + [(999, None, "ab")]
    df = spark.createDataFrame(data, "id long, k int, v string").repartition(5)
    ranks = {k: i for i, k in enumerate(sorted({k for _, k, _ in data if k is not None}))}
    pairs = [(a, b) for (a, ka, _), (b, kb, _) in itertools.combinations(data, 2)
             if ka is not None and kb is not None and abs(ranks[ka] - ranks[kb]) <= 1]
    vectors = matching.similarity_vectors(cand.candidates(df, "id", ["k"], ignore=["k"]))
    want = {}
    text = {i: v for i, _, v in data}
    for a, b in pairs:
        s = round(sim(text[a], text[b]), 9)
        want[s] = want.get(s, 0) + 1
    assert {round(r["s0"], 9): r["pair_count"] for r in vectors.collect()} == want
    assert cand.neighbourhoods(df, "k").agg(F.sum("pair_count")).first()[0] == len(pairs)
    got = rows_of(link.find_clusters(df, "id", ["k"], ignore=["k"], threshold=0.7))
    assert got == components([(a, b) for a, b in pairs if sim(text[a], text[b]) >= 0.7])


def test_hot_block_of_copies(spark):
    """A third of all rows are copies of one record; they are compared as one."""
    df = spark.range(30_000).selectExpr(
        "id", "if(id % 3 = 0, 'same', concat('block', id)) AS k", "if(id % 3 = 0, 'text', concat('t', id)) AS v")
    found = cand.candidates(df, "id", ["k", "v"])
    assert matching.similarity_vectors(found).agg(F.sum("pair_count")).first()[0] == 10_000 * 9_999 // 2
    clusters = link.find_clusters(df, "id", ["k", "v"], threshold=0.9)
    assert clusters.count() == 10_000 and clusters.select("cluster_id").distinct().count() == 1


def test_hot_block_of_different_records(spark, monkeypatch):
    monkeypatch.setattr(cand, "TILE", 64)
    df = spark.range(900).selectExpr("id", "if(id < 300, 'hot', concat('k', id)) AS k", "1 AS j",
                                     "concat('abcdefgh', id) AS v")
    clusters = link.find_clusters(df, "id", ["k", "j"], ignore=["k", "j"], threshold=0.7)
    assert clusters.count() == 300 and clusters.agg(F.max("cluster_id")).first()[0] == 0


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_similar_texts_share_a_key(similarity):
    rand = random.Random(21)
    met = 0
    for _ in range(3000):
        text = "".join(rand.choice("abc") for _ in range(rand.randrange(1, 14)))
        other = list(text)
        for _ in range(rand.randrange(4)):
            at, move = rand.randrange(len(other) + 1), rand.randrange(4)
            if move == 0:
                other.insert(at, rand.choice("abc"))
            elif move == 1 and at < len(other) > 1:
                other.pop(at)
            elif at + 1 < len(other):
                other[at:at + 2] = [other[at + 1], other[at]]
            elif at < len(other):
                other[at] = rand.choice("abc")
        short, long_ = sorted((text, "".join(other)), key=len)
        if 1 - distance(short, long_) / len(long_) >= similarity - 1e-9:
            assert segments.shorter_keys(short, similarity) & segments.longer_keys(long_, similarity)
            met += 1
    assert met > 200


@pytest.mark.parametrize("tile", [3, 1024])
def test_segments_give_the_links_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(cand, "TILE", tile)
    rand = random.Random(5)
    names = ["".join(rand.choice("abcdefgh") for _ in range(rand.randrange(6, 16))) for _ in range(60)]
    rows = []
    for n in range(200):
        name = list(rand.choice(names))
        if rand.random() < 0.5:
            at = rand.randrange(len(name) - 1)
            name[at], name[at + 1] = name[at + 1], name[at]
        rows.append((n, "".join(name) if rand.random() < 0.95 else None, f"city{rand.randrange(90)}"))
    df = spark.createDataFrame(rows, "id long, name string, city string")
    used = []
    whole = cand._segment_cells
    monkeypatch.setattr(cand, "_segment_cells", lambda *a: used.append(whole(*a)) or used[-1])
    got = rows_of(link.find_clusters(df, "id", threshold=0.85))
    assert used[0] is not None
    monkeypatch.setattr(cand, "_segment_cells", lambda *a: None)
    assert got == rows_of(link.find_clusters(df, "id", threshold=0.85)) and got


def test_long_texts_against_short_form(monkeypatch):
    from tablewash.functions import similarity as sim

    rand = random.Random(11)
    left, right = [], []
    for _ in range(300):
        text = [rand.choice("abcd") for _ in range(rand.randrange(1, 30))]
        other = text[:]
        for _ in range(rand.randrange(9)):
            at = rand.randrange(len(other) + 1)
            move = rand.randrange(4)
            if move == 0:
                other.insert(at, rand.choice("abcde"))
            elif move == 1 and at < len(other) and len(other) > 1:
                other.pop(at)
            elif at + 1 < len(other):
                other[at], other[at + 1] = other[at + 1], other[at]
        left.append("".join(text))
        right.append("".join(other))
    want = sim.damerau_levenshtein(left, right)
    monkeypatch.setattr(sim, "LONG", 0)
    assert (sim.damerau_levenshtein(left, right) == want).all()


def test_limits_tell_what_distances_tell(monkeypatch):
    from tablewash.functions import similarity as sim

    rand = random.Random(13)
    left, right = [], []
    for _ in range(300):
        text = [rand.choice("abcd") for _ in range(rand.randrange(1, 20))]
        other = text[:] if rand.random() < 0.6 else [rand.choice("abcd") for _ in range(rand.randrange(1, 20))]
        for _ in range(rand.randrange(6)):
            at = rand.randrange(len(other) + 1)
            move = rand.randrange(4)
            if move == 0:
                other.insert(at, rand.choice("abcde"))
            elif move == 1 and at < len(other) and len(other) > 1:
                other.pop(at)
            elif at + 1 < len(other):
                other[at], other[at + 1] = other[at + 1], other[at]
        left.append("".join(text))
        right.append("".join(other))
    position = np.arange(len(left))
    texts = sim.Texts([*left, *right])
    want = sim.distances(texts, position, position + len(left))
    monkeypatch.setattr(sim, "LONG", 0)
    monkeypatch.setattr(sim, "LOOK_ROWS", 3)
    for limit in range(12):
        got = sim.distances(texts, position, position + len(left), np.full(len(left), limit))
        assert ((got <= limit) == (want <= limit)).all()


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.95])
def test_long_texts_match_by_threshold(threshold):
    """Two columns, so that the limit of the longer one depends on the shorter one."""
    rand = random.Random(14)
    texts = ["".join(rand.choice("abcdef ") for _ in range(250)) for _ in range(6)]
    for _ in range(30):
        other = list(rand.choice(texts))
        for _ in range(rand.randrange(90)):
            at = rand.randrange(len(other) - 1)
            other[at:at + 2] = rand.choice([[other[at + 1], other[at]], ["x"], [other[at], "y", other[at + 1]]])
        texts.append("".join(other))
    names = [rand.choice(["John", "Jonh", "Jo", ""]) for _ in texts]
    left, right = map(np.array, zip(*itertools.combinations(range(len(texts)), 2)))
    books = [Codebook(np.array([sorted(set(column)).index(v) for v in column]), sorted(set(column)))
             for column in (names, texts)]
    scores = [(sim(names[a], names[b]) + 1 - d / max(len(texts[a]), len(texts[b]))) / 2 for a, b, d in
              zip(left, right, damerau_levenshtein([texts[a] for a in left], [texts[b] for b in right]))]
    got = matching._matching(books, left, right, matching.threshold_decision(2, threshold))
    assert got.tolist() == [n for n, s in enumerate(scores) if s >= threshold - 1e-9]


def test_many_long_texts_are_told_apart_in_seconds():
    rand = random.Random(15)
    texts = ["".join(rand.choice("abcdefgh ") for _ in range(2000)) for _ in range(20)]
    left, right = map(np.array, zip(*itertools.combinations(range(20), 2)))
    begin = time.perf_counter()
    got = matching._matching([Codebook(np.arange(20), texts)], left, right, matching.threshold_decision(1, 0.7))
    assert time.perf_counter() - begin < 8 and not len(got)


def varied(rand, signs, most, moves, kept=0.6):
    """Pairs of texts, most of them made of each other by some changes, also swaps over other signs."""
    left, right = [], []
    for _ in range(most):
        text = [rand.choice(signs) for _ in range(rand.randrange(1, 200))]
        other = text[:] if rand.random() < kept else [rand.choice(signs) for _ in range(rand.randrange(1, 200))]
        for _ in range(rand.randrange(moves)):
            at, move = rand.randrange(len(other) + 1), rand.randrange(5)
            if move == 0:
                other.insert(at, rand.choice(signs))
            elif move == 1 and at < len(other) and len(other) > 1:
                other.pop(at)
            elif at + 3 < len(other):
                apart, size = rand.randrange(1, 3), rand.randrange(3)
                other[at], other[at + apart] = other[at + apart], other[at]
                if apart == 2 and size < 2:
                    other[at + 1:at + 2] = rand.choices(signs, k=2 * size)
        left.append("".join(text))
        right.append("".join(other))
    return left, right


@pytest.mark.parametrize("signs", ["ab", "abcdefgh", "".join(map(chr, range(200, 300)))])
def test_nothing_within_its_limit_is_proven_beyond(monkeypatch, signs):
    from tablewash.functions import similarity as sim

    rand = random.Random(17)
    left, right = varied(rand, signs, 300, 60)
    position = np.arange(len(left))
    texts = sim.Texts([*left, *right])
    want = sim.distances(texts, position, position + len(left))
    monkeypatch.setattr(sim, "BRIEF", 0)
    monkeypatch.setattr(sim, "FEW_SIGNS", 0)
    longer = np.maximum(texts.lengths[:len(left)], texts.lengths[len(left):])
    for limits in (want - 1, want, want // 2, longer // 5, 3 * longer // 10, np.zeros_like(want)):
        limits = np.maximum(limits, 0)
        got = sim.beyond(texts, position, position + len(left), limits)
        assert not (got & (want <= limits)).any()
        assert got.sum() >= (want > 2 * limits + 20).sum()


def test_most_long_texts_are_told_apart_together(monkeypatch):
    """Of thousands of pairs that have nothing to do with each other hardly one is compared on its own."""
    from tablewash.functions import similarity as sim

    rand = random.Random(18)
    texts = ["".join(rand.choice("abcdefgh ") for _ in range(600)) for _ in range(100)]
    texts += [text[:50] + "x" + text[52:] for text in texts[:10]]
    alone, within = [], sim._within
    monkeypatch.setattr(sim, "_within", lambda *a: alone.append(1) or within(*a))
    zeros = pa.array(np.zeros(len(texts), dtype=np.int64))
    group = pa.table({"block": zeros, "kind": zeros, "row_tile": zeros, "col_tile": zeros, "side": zeros,
                      "sid": pa.array(np.arange(len(texts))), "copies": zeros, "_s0": pa.array(texts)})
    links = [row for batch in matching._links(group, ["_s0"], matching.threshold_decision(1, 0.7)) for row in batch.to_pylist()]
    assert sorted((row["a"], row["b"]) for row in links) == [(n, 100 + n) for n in range(10)]
    assert len(alone) < 100


def test_repeated_long_texts_are_told_apart_together():
    """Two columns with few texts in one: as many rows as pairs of texts, limits that depend on the other column."""
    rand = random.Random(19)
    texts = ["".join(rand.choice("abc ") for _ in range(300)) for _ in range(6)]
    texts += [text[:100] + "".join(rand.choice("xyz") for _ in range(n)) + text[100 + n:]
              for n, text in zip((20, 60, 90, 120, 150, 180), texts)]
    names = ["John", "Jonh", "Jo", ""]
    rows = [(rand.choice(names), rand.choice(texts)) for _ in range(60)]
    left, right = map(np.array, zip(*itertools.combinations(range(60), 2)))
    decision = matching.threshold_decision(2, 0.7)

    def books():
        return [Codebook(np.array([column.index(row[i]) for row in rows]), column) for i, column in enumerate((names, texts))]

    want = matching._matching(books(), left, right, decision)
    tried = books()
    for _ in range(2):
        left_over = matching._matching(tried, left, right, decision, proof=True)
        assert set(want) <= set(left_over) and len(left_over) < len(left) / 2
    assert 0 < len(want)


def test_whole_tables_are_counted_by_groups(spark, monkeypatch):
    """Records equal in all columns but two meet the whole table at once, with the same counts as pair by pair."""
    rand = random.Random(21)
    rows = [(n, rand.choice(["hot bolt", "old ring", "cold gear", None, ""]), f"Brand#{rand.randrange(12)}",
             rand.choice(["LARGE", "SMALL", "ECO"]), rand.randrange(9), rand.randrange(40) / 10 + 900) for n in range(2_500)]
    df = spark.createDataFrame(rows + [(9_000 + n, *rows[n][1:]) for n in range(40)],
                               "id long, a string, b string, c string, d int, e double").repartition(3)

    def counted():
        return sorted(map(tuple, matching.similarity_vectors(cand.candidates(df, "id")).collect()))

    want = counted()
    assert sum(row[-1] for row in want) == 2_540 * 2_539 // 2
    monkeypatch.setattr(matching, "PAIR_COST", 10 ** 9)
    met, meet = [], matching._grouped_vectors
    monkeypatch.setattr(matching, "_grouped_vectors", lambda *a: met.append(1) or meet(*a))
    assert counted() == want and met
    monkeypatch.setattr(matching, "FACTOR_CELLS", 500)
    monkeypatch.setattr(cand, "GROUPED_ROWS", 900)
    assert counted() == want
    monkeypatch.setattr(matching, "EXACT", 10)
    monkeypatch.setattr(matching, "COUNT_TABLE", 10)
    assert counted() == want


def test_pairs_of_records_do_not_cost_their_number(spark):
    """Twenty thousand different records of few texts make two hundred million pairs, but few groups."""
    df = spark.range(24_000).selectExpr("id", "id % 2 a", "id div 2 % 3 b", "id div 6 % 40 c", "id div 240 d")
    found = cand.candidates(df, "id")
    assert matching._grouped_order(found) == [0, 1, 2, 3]
    counts = matching.similarity_vectors(found)
    assert counts.agg(F.sum("pair_count")).first()[0] == 24_000 * 23_999 // 2


def test_few_short_texts_with_limits_take_no_time():
    from tablewash.functions import similarity as sim

    rand = random.Random(20)
    left, right = varied(rand, "abcd ", 8, 40, kept=1)
    left, right = [text + "y" * 60 for text in left], ["x" + text + "z" * 60 for text in right]
    texts, position = sim.Texts([*left, *right]), np.arange(8)
    want = sim.distances(texts, position, position + 8)
    limits = np.array([int(n) + turn for n, turn in zip(want, [0, -1] * 4)])
    begin = time.perf_counter()
    got = sim.distances(texts, position, position + 8, limits)
    assert time.perf_counter() - begin < 0.1
    assert ((got <= limits) == (want <= limits)).all()


def test_long_texts_make_small_cells(spark):
    rand = random.Random(16)
    rows = [(n, "x", "y", "".join(rand.choice("abc ") for _ in range(2000))) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, j string, v string")
    found = cand.candidates(df, "id", ["k", "j"], ignore=["k", "j"])
    sizes = [r["count"] for r in cand.cells(found).groupBy(*cand.CELL[:-1]).count().collect()]
    assert max(sizes) < 250 and len(sizes) == 15
    short = cand.candidates(df.withColumn("v", F.substring("v", 1, 20)), "id", ["k", "j"], ignore=["k", "j"])
    assert cand.cells(short).groupBy(*cand.CELL[:-1]).count().count() == 1


def test_long_texts_take_seconds():
    from tablewash.functions import similarity as sim

    rand = random.Random(12)
    texts = ["".join(rand.choice("abcdefgh ") for _ in range(2000)) for _ in range(8)]
    begin = time.perf_counter()
    found = sim.damerau_levenshtein(texts[:4], texts[4:])
    assert time.perf_counter() - begin < 10 and (found > 500).all()


def cell(rows, across):
    """Rows ``(sid, copies, text, text)`` as one cell, or as two tiles that are compared with each other."""
    side = [int(across and n >= len(rows) // 3) for n in range(len(rows))]
    return pa.table({"block": [7] * len(rows), "kind": [0] * len(rows), "row_tile": [0] * len(rows),
                     "col_tile": [int(across)] * len(rows), "side": pa.array(side, pa.int32()),
                     **dict(zip(["sid", "copies", "_s0", "_s1"], map(list, zip(*rows))))})


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("copies", [1, 3])
def test_large_cells(monkeypatch, across, copies):
    """By tables of all texts, and piece by piece."""
    monkeypatch.setattr(matching, "STEP_ROWS", 8)
    monkeypatch.setattr(matching, "COUNT_PAIRS", 50)
    rand = random.Random(31)
    words = ["".join(rand.choice("abc") for _ in range(rand.randrange(5))) for _ in range(30)] + [None]
    rows = [(n, rand.randrange(1, copies + 1), rand.choice(words), rand.choice(words)) for n in range(60)]
    group = cell(rows, across)
    pairs = [(a, b) for a, b in itertools.combinations(rows, 2) if not across or (a[0] < 20) != (b[0] < 20)]
    scored = [((sim(a[2], b[2]), sim(a[3], b[3])), a, b) for a, b in pairs]
    want = {}
    for vector, a, b in scored:
        want[vector] = want.get(vector, 0) + a[1] * b[1]
    texts, names = ["_s0", "_s1"], ["s0", "s1"]
    got = matching._counts_by_table(group, texts, names).to_pylist()
    assert {(r["s0"], r["s1"]): r["pair_count"] for r in got} == want
    links = components([(a[0], b[0]) for (x, y), a, b in scored if x + y >= 1.4])
    decision = matching.threshold_decision(2, 0.7)
    for limit in (2048, 2):
        monkeypatch.setattr(matching, "TABLE_TEXTS", limit)
        parts = [part for part, _ in matching._parts(group, texts)]
        assert (len(parts) > 10) == (limit == 2) and max(part.num_rows for part in parts) <= (60 if limit > 2 else 8)
        found = [(r["a"], r["b"]) for batch in matching._links(group, texts, decision) for r in batch.to_pylist()]
        assert components(found) == links
    assert matching._counts_by_table(group, texts, names) is None
    pieces = {}
    for part, _ in matching._parts(group, texts):
        books, weights = matching._codebooks(part, texts), part["copies"].to_numpy()
        for left, right in matching._pairs(part, 50):
            for r in matching._vector_counts(books, left, right, weights[left] * weights[right], names).to_pylist():
                pieces[r["s0"], r["s1"]] = pieces.get((r["s0"], r["s1"]), 0) + r["pair_count"]
    assert pieces == want


def test_cells_of_a_whole_table_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(cand, "TILE", 8)
    df = spark.range(1000).selectExpr("id", "concat('a', id) AS v")
    assert cand.cells(cand.candidates(df, "id")).count() <= cand.MOST_TILES * 1000


@pytest.mark.parametrize("most", [0.2, 0.9])
def test_only_outsiders_meet_all(spark, monkeypatch, most):
    """Most records are linked by their neighbours in some order; the rest is still compared with all of them."""
    monkeypatch.setattr(cand, "TILE", 2)
    monkeypatch.setattr(cand, "_segment_cells", lambda *a: None)
    used = []
    whole = cand.outside_cells
    monkeypatch.setattr(cand, "outside_cells", lambda *a: used.append(a[2]) or whole(*a))
    rand = random.Random(33)
    rows = []
    for n in range(120):
        near = rand.random() < most
        name = "".join(rand.choice("ab" if near else "cdefghij") for _ in range(5))
        rows.append((n, name, "town" if near else name[::-1], None if n % 17 == 0 else 7))
    rows.append((500, rows[3][1], rows[3][2], rows[3][3]))
    df = spark.createDataFrame(rows, "id long, name string, city string, age int")
    found = df.collect()
    pairs = list(itertools.combinations(sorted(r["id"] for r in found), 2))
    want = expected(found, pairs, ["name", "city", "age"], 0.7)
    assert rows_of(link.find_clusters(df, "id", threshold=0.7)) == want
    assert bool(used) == (most > 0.5)


def test_two_groups(people):
    """The similar pairs end up in the upper group."""
    got = rows_of(link.find_clusters(people, "id", ["city", "age"]))
    assert got[10] == got[11] == got[12] == 10 and got[13] == got[14] == got[15] == 13


def test_fewer_than_two_pairs_all_match(spark):
    df = spark.createDataFrame([(1, "x", "y", "abc"), (2, "x", "y", "zzz"), (3, "q", "r", "s")],
                               "id long, a string, b string, c string")
    assert rows_of(link.find_clusters(df, "id", ["a", "b"])) == {1: 1, 2: 1}
    assert link.find_clusters(df.where("id <> 2"), "id", ["a", "b"]).count() == 0


def test_refusals(people):
    with pytest.raises(AttrTypeError):
        link.find_clusters(people, "first", threshold=0.9)
    with pytest.raises(InvalidValueError):
        link.find_clusters(people, "id", ignore=["first", "last", "age", "city"], threshold=0.9)
    with pytest.raises(InvalidValueError):
        link.find_clusters(people, "id", ["city", "age"], threshold=2)


@pytest.mark.parametrize("at_once", [3, 1_000_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(link, "CONTRACT_LINKS", at_once)
    rand = random.Random(3)
    chain = list(range(120))
    rand.shuffle(chain)
    for edges in (list(zip(chain, chain[1:])), [(5, i) for i in range(6, 99)] + [(7, 7), (200, 200), (201, 300)],
                  [(rand.randrange(200), rand.randrange(200)) for _ in range(120)]):
        df = spark.createDataFrame(edges, "a long, b long")
        got = {r["id"]: r["label"] for r in link.connected_components(df).collect()}
        assert got == components(edges)


def test_resolution(spark, people):
    clusters = spark.createDataFrame([(10, 10), (11, 10), (12, 10), (13, 13), (14, 13), (15, 13)],
                                     "id long, cluster_id long")

    def removed(**choice):
        return sorted(r["id"] for r in link.rows_to_remove(clusters, "id", **choice).collect())

    assert removed() == [11, 12, 14, 15]
    assert removed(yes_from=13) == [14, 15]
    keep = spark.createDataFrame([(10, 11), (10, 12)], "cluster_id long, keep_row_id long")
    assert removed(keep=keep) == [10, 14, 15]
    assert removed(keep=keep, yes_from=14) == [10]
    none = spark.createDataFrame([(13, None)], "cluster_id long, keep_row_id long")
    assert removed(keep=none) == [11, 12, 13, 14, 15]
    review = link.review_rows(people, "id", clusters).collect()
    assert [r["id"] for r in review] == [10, 11, 12, 13, 14, 15] and review[0]["first"] == "John"
    kept = link.remove_rows(people, "id", link.rows_to_remove(clusters, "id"))
    assert kept.columns == people.columns and kept.count() == 7


def test_redo_removal(spark, monkeypatch):
    monkeypatch.setattr(link, "COPIES_PER_TASK", 3)
    df = spark.createDataFrame([("a", 1)] * 10 + [("b", None)] * 3 + [("c", 2)], "x string, y int")
    gone = spark.createDataFrame([("a", 1)] * 2 + [("b", None)] * 5 + [("z", 0)], "x string, y int")
    assert sorted(map(tuple, link.redo_removal(df, gone).collect())) == [("a", 1)] * 8 + [("c", 2)]
    assert sorted(map(str, link.redo_removal(df, gone).collect())) == sorted(map(str, df.exceptAll(gone).collect()))

import hashlib
import random

import helpers
import numpy as np
import xxhash

from tablewash.llm import simhash

MASK = (1 << 64) - 1


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[n:n + 3]) for n in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(pairs, radius=3):
    ids = list(range(len(pairs)))
    label = ids[:]
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                    label[i], changed = label[j], True
    return label


def texts():
    rng = random.Random(4)
    rows = []
    for n in range(40):
        words = helpers.sentence(n, 300).split()
        for copy in range(1 + n % 4):
            changed = words[:]
            for _ in range(copy):
                changed[rng.randrange(len(changed))] = f"new{rng.randrange(9)}"
            rows.append((len(rows) * 3 % 101, " ".join(changed)))
    return rows


def test_against_brute_force(spark):
    rows = texts() + [(900, None), (901, ""), (902, "One two"), (903, "ONE\ttwo")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_copies(documents).collect()}
    prints = [(doc, plain_fingerprint(text)) for doc, text in rows]
    label = plain_components(prints)
    smallest = {}
    for n, (doc, _) in enumerate(prints):
        smallest[label[n]] = min(doc, smallest.get(label[n], doc))
    assert got == {doc: (f"{fp:016x}", smallest[label[n]]) for n, (doc, fp) in enumerate(prints)}
    assert len({c for _, c in got.values()}) < len(got)


def test_links_of_planted_distances(spark):
    rng = random.Random(8)
    values = []
    for _ in range(60):
        value = rng.getrandbits(64)
        values.append(value)
        for _ in range(3):
            flips = rng.sample(range(64), rng.choice([1, 3, 4, 7]))
            values.append(value ^ sum(1 << bit for bit in flips))
    signed = [v - (1 << 64) if v >> 63 else v for v in dict.fromkeys(values)]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=7).collect()
    label = plain_components([(n, v & MASK) for n, v in enumerate(signed)])
    place = {v: n for n, v in enumerate(signed)}
    left = np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links])
    got = simhash.forest(*left, np.arange(len(signed)))
    for i in range(len(signed)):
        for j in range(i):
            assert (label[i] == label[j]) == (got[i] == got[j])


def test_planes_against_popcount():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    values[100:200] = values[:100] ^ np.uint64(0b1011)
    values[200:300] = values[:100] ^ np.uint64(0b101101)
    for groups in (np.zeros(700, dtype=int), np.sort(rng.integers(0, 50, 700)), np.arange(700)):
        for radius in (0, 1, 3, 5):
            near = (np.bitwise_count(values[:, None] ^ values[None]) <= radius) & (groups[:, None] == groups[None])
            label = np.arange(700)
            while True:
                new = np.array([label[row].min() for row in near])
                if (new == label).all():
                    break
                label = new
            assert (simhash.near_labels(values, groups, radius) == label).all()


def test_edge_rows(spark):
    documents = helpers.clashing(helpers.edge_documents(spark))
    got = simhash.near_copies(documents).collect()
    assert len(got) == documents.count()
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in got if r.doc_id in (1, 8)} == {1}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = simhash.drop_near_copies(documents)
    assert kept.columns == documents.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 5, 7, 9, None]
    empty = documents.limit(0)
    assert simhash.near_copies(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_components_that_share_an_id_keep_a_row_each(spark):
    one, other, third = (helpers.sentence(n, 200) for n in (901, 902, 903))
    rows = [(None, one), (None, other), (None, other), (3, third), (7, third), (7, helpers.sentence(904, 200)), (8, ""), (8, None)]
    documents = helpers.clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    label = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert len({label[0], label[1], label[3], label[5], label[6]}) == 5
    want = {}
    for (doc, text), name in zip(rows, label):
        mark = "" if text is None else hashlib.md5(text.encode()).hexdigest()
        fp = plain_fingerprint(text)
        row = ((doc is None, doc or 0, fp - (1 << 64) if fp >> 63 else fp, mark), doc, text)
        want[name] = min(row, want.get(name, row), key=lambda r: r[0])
    got = simhash.drop_near_copies(documents)
    assert got.columns == documents.columns
    assert helpers.rows(got.select("doc_id", "text")) == sorted((r[1:] for r in want.values()), key=repr)

import collections
import random

import helpers
import numpy as np

from tablewash.llm import paragraphs, passages


def plain(rows, least=20, limit=0.8):
    held = []
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = line.encode().lower().split()
            if len(words) >= max(1, least):
                held.append(((doc is not None, doc), n, frozenset(
                    tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))))
    label = list(range(len(held)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(held)):
        for j in range(i):
            a, b = held[i][2], held[j][2]
            if len(a & b) >= limit * len(a | b) - 1e-9:
                one, other = sorted((top(i), top(j)))
                label[other] = one
    groups = collections.defaultdict(list)
    for k in range(len(held)):
        groups[top(k)].append(held[k][:2])
    return sorted((doc[1], n, min(g)[0][1], min(g)[1], len(g)) for g in groups.values() if len(g) > 1 for doc, n in g)


def found(df):
    return sorted((r.doc_id, r.paragraph, r.first_doc_id, r.first_paragraph, r.copies) for r in df.collect())


def corpus():
    rng = random.Random(6)
    passages = [helpers.sentence(7000 + n, 30 + n, 5000) for n in range(25)]
    rows = []
    for n in range(200):
        lines = [helpers.sentence(100 * n + k, rng.randrange(1, 70), 5000) for k in range(rng.randrange(1, 6))]
        for passage in rng.sample(passages, rng.randrange(0, 3)):
            words = passage.split()
            for _ in range(rng.choice([0, 0, 0, 1, 1, 3])):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
            lines.insert(rng.randrange(len(lines) + 1), " ".join(words))
        rows.append((n, "\n".join(lines)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain(rows)
    assert found(paragraphs.repeated_paragraphs(documents)) == want and len(want) > 100
    monkeypatch.setattr(paragraphs, "TILE", 4)
    monkeypatch.setattr(paragraphs, "SEND_ROWS", 0)
    assert found(paragraphs.repeated_paragraphs(documents)) == want
    texts = dict(rows)
    for r in paragraphs.repeated_paragraphs(documents).collect():
        line = texts[r.doc_id].split("\n")[r.paragraph]
        assert texts[r.doc_id][r.start:r.start + r.length] == line and r.n_words == len(line.split())
        assert r.removed == ((r.doc_id, r.paragraph) != (r.first_doc_id, r.first_paragraph))


def test_drop_repeated(spark):
    rows = corpus() + [(1000, None), (1001, "")]
    documents = helpers.clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = collections.defaultdict(set)
    for doc, n, first, at, _ in plain(rows):
        if (doc, n) != (first, at):
            gone[doc].add(n)
    got = {r.doc_id: r.text for r in paragraphs.drop_repeated(documents).collect()}
    for doc, text in rows:
        left = text if not gone[doc] else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[doc])
        assert got[doc] == left
    assert paragraphs.drop_repeated(documents).columns == documents.columns


def test_edge_rows(spark):
    documents = helpers.clashing(helpers.edge_documents(spark))
    rows = [(r[0], r[1]) for r in helpers.edge_rows()]
    got = found(paragraphs.repeated_paragraphs(documents, least=3))
    assert [(str(a), b, str(c), d, n) for a, b, c, d, n in got] == [
        (str(a), b, str(c), d, n) for a, b, c, d, n in plain(rows, 3)]
    assert paragraphs.repeated_paragraphs(documents).count() == 0
    assert paragraphs.repeated_paragraphs(documents.limit(0)).count() == 0
    null_first = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], documents.schema[:2])
    assert [tuple(r) for r in paragraphs.repeated_paragraphs(null_first, least=3).select(
        "doc_id", "first_doc_id", "removed").orderBy("doc_id").collect()] == [(None, None, False), (3, None, True)]


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.95, 1.0):
        bands, rows = paragraphs.tune_bands(similarity)
        assert bands <= paragraphs.MOST_BANDS
        if similarity >= 0.8:
            assert 1 - (1 - similarity ** rows) ** bands >= paragraphs.RECALL


def test_exact_similarity():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60))).astype(np.uint64) for _ in range(60)]
    got = set(zip(*map(list, paragraphs.similar(sets, 0.5))))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60)
            if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert got == want


def test_no_task_holds_a_large_set(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "TILE", 16)
    rows = [(key, band) for key in range(400) for band in (1, 2)] + [(900, 3), (901, 3), (902, 4)]
    sets = paragraphs._sets(spark.createDataFrame(rows, "key long, band long"))
    assert sets.count() == 402
    groups = collections.defaultdict(set)
    for r in paragraphs._dealt(sets).collect():
        groups[r.name, r.tile, r.other].add(r.key)
    assert max(map(len, groups.values())) < 100 and len(groups) > 300
    met = {(a, b) for keys in groups.values() for a in keys for b in keys if a < b}
    assert met == {(a, b) for a in range(400) for b in range(a + 1, 400)} | {(900, 901)}


def test_runs_in_longer_lines_and_short_lines(spark):
    passage, wrapped, brief = (helpers.sentence(n, 60, 5000).split() for n in (801, 802, 803))
    around = lambda n, words: helpers.sentence(820 + n, words, 5000)
    rows = [(1, f"{around(1, 80)} {' '.join(passage)} {around(2, 70)}"), (2, f"é {' '.join(passage).upper()} {around(3, 90)}"),
            (3, " ".join(passage)), (4, "\n".join(" ".join(wrapped[n:n + 9]) for n in range(0, 60, 9))),
            (None, around(4, 30) + "\n" + "\n".join(" ".join(wrapped[n:n + 13]) for n in range(0, 60, 13))),
            (6, f"{around(5, 60)} {' '.join(brief[:49])} {around(6, 60)}"), (7, f"{around(7, 60)} {' '.join(brief[:49])} x"),
            (8, " ".join(["again"] * 200)), (9, None), (10, around(8, 55)), (11, around(8, 55))]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = paragraphs.repeated_passages(documents).collect()
    texts = dict(rows)
    runs = {r.doc_id: r for r in got if r.paragraph is None}
    assert len(got) == 7 and runs.keys() == {1, 2, 3, 4, None}
    for doc, words in ((1, passage), (2, passage), (3, passage), (4, wrapped), (None, wrapped)):
        r = runs[doc]
        assert texts[doc][r.start:r.start + r.length].lower().split() == words and r.n_words == 60
        assert r.first_doc_id == (1 if words is passage else None) and r.removed == (doc not in (1, None))
        assert r.copies == (3 if words is passage else 2)


def run_rows():
    """Texts that share parts of one source, with ids that are null, repeated with unlike texts, or beyond what a float holds."""
    rng = random.Random(12)
    source = helpers.sentence(840, 400, 5000).split()
    rows = []
    for n in range(60):
        words = helpers.sentence(850 + n, 150, 5000).split()
        begin, size = rng.randrange(300), rng.randrange(35, 100)
        words[rng.randrange(150):0] = source[begin:begin + size]
        doc = None if n % 9 == 4 else 77 if n % 11 == 5 else (1 << 60) + n if n % 3 else n
        rows.append((doc, "".join(w + rng.choice([" "] * 9 + ["\n"]) for w in words)))
    return rows + [rows[0], rows[4], (200, " ".join(["again"] * 120)), (201, " ".join(["again"] * 70)),
                   (202, " ".join(["only", "here"] * 90))]


def test_runs_against_brute_force(spark, monkeypatch):
    rows = run_rows()
    held = collections.defaultdict(list)
    for doc, text in sorted(set(rows), key=lambda row: (row[0] is not None, row[0] or 0)):
        words = text.split()
        for k in range(len(words) - 49):
            held[tuple(words[k:k + 50])].append((doc, text, k))
    shared = {window for window, places in held.items() if len({place[:2] for place in places}) > 1}
    want = collections.Counter()
    for doc, text in rows:
        words = text.split()
        for at in {k + n for k in range(len(words) - 49) if tuple(words[k:k + 50]) in shared for n in range(50)}:
            want[doc, text, at] += 1
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for send in (passages.SEND_BYTES, 0):
        monkeypatch.setattr(passages, "SEND_BYTES", send)
        got = paragraphs.repeated_passages(documents).collect()
        runs = [r for r in got if r.paragraph is None]
        covered = set()
        for r in got:
            # The text of a row is the one with these words at this place.
            mine = [text for doc, text in set(rows) if doc == r.doc_id and len(text) >= r.start + r.length
                    and len(text[r.start:r.start + r.length].split()) == r.n_words
                    and (r.paragraph is not None or tuple(text[r.start:r.start + r.length].split()[:50]) in shared)]
            assert mine and r.first_doc_id in {doc for doc, _ in rows}
            if len(mine) == 1:
                before = len(mine[0][:r.start].split())
                covered |= {(r.doc_id, mine[0], before + n) for n in range(r.n_words)}
                assert r.paragraph is not None or {(r.doc_id, mine[0], before + n) for n in range(r.n_words)} <= set(want)
        alone = {place for place in want if sum(doc == place[0] for doc, _ in set(rows)) == 1}
        assert alone <= covered and len(alone) > 500 and len(runs) > 20
    # The row that holds the first of all equal windows keeps it, all others lose it.
    first = {window: min(held[window], key=lambda p: (p[0] is not None, p[0] or 0)) for window in shared}
    for r in got:
        if r.doc_id not in (None, 77) and r.paragraph is None:
            text = dict(rows)[r.doc_id]
            doc, _, _ = first[tuple(text[r.start:].split()[:50])]
            assert r.removed == (doc != r.doc_id) and r.first_doc_id == doc


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    passage, line = helpers.sentence(901, 60, 5000), helpers.sentence(902, 30, 5000)
    for doc in (None, 5):
        rows = [(doc, f"{helpers.sentence(903 + n, 60, 5000)} {passage} {n}\n{line}") for n in range(2)]
        got = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.paragraph is None, r.removed) for r in got) == [
            (False, False), (False, True), (True, False), (True, True)]
        kept = paragraphs.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(line in r.text for r in kept) == [False, True]

import collections
import math

import helpers
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tablewash.llm import katz


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


class Plain:
    """The model word by word, with dictionaries."""

    def __init__(self, texts):
        self.uni, self.two, self.context = collections.Counter(), collections.Counter(), collections.Counter()
        for text in texts:
            words = tokens(text)
            self.uni.update(words)
            for pair in zip(["begin", *words[:-1]], words):
                self.two[pair] += 1
                self.context[pair[0]] += 1
        self.total, self.words = sum(self.uni.values()), len(self.uni)
        count = lambda c: {r: n for r, n in collections.Counter(c.values()).items() if r <= 6}
        one, two = katz.discounts(count(self.uni)), katz.discounts(count(self.two))
        less = lambda c, f: c * f[c] if c <= 5 else c - 0.5
        self.one = {w: less(c, one) / self.total for w, c in self.uni.items()}
        self.unknown = 1 - sum(self.one.values())
        self.pair = {p: less(c, two) / self.context[p[0]] for p, c in self.two.items()}
        self.weight = {}
        for h in self.context:
            seen = [p for p in self.two if p[0] == h]
            self.weight[h] = (1 - sum(self.pair[p] for p in seen)) / (1 - sum(self.one[p[1]] for p in seen))

    def probability(self, h, w):
        if (h, w) in self.pair:
            return self.pair[h, w]
        return self.weight.get(h, 1) * self.one.get(w, self.unknown)

    def score(self, text):
        words = tokens(text)
        base = sum(math.log10((self.uni[w] + 1) / (self.total + self.words + 1)) for w in words)
        score = sum(math.log10(self.probability(h, w)) for h, w in zip(["begin", *words[:-1]], words))
        return len(words), sum(self.uni[w] > 0 for w in words), self.total, base, score


def texts(count=300):
    return [helpers.sentence(n, 1 + n % 50, 80 if n % 3 else 2000) for n in range(count)]


@pytest.mark.parametrize("hot, piece", [(50_000, 12 << 20), (20, 2000)])
def test_against_brute_force(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "MOST_HOT", 10 ** 9)
    monkeypatch.setattr(katz, "PIECE", piece)
    rows = [(n, text, n % 7 == 2) for n, text in enumerate(texts())]
    rows += [(1000, None, False), (1001, "", True), (1002, " \t ", True), (1003, "never seen words", True)]
    plain = Plain([text for _, text, held in rows if not held])
    documents = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    got = {r.doc_id: r for r in katz.Katz(documents).scores().collect()}
    assert len(got) == len(rows)
    for doc, text, held in rows:
        r, want = got[doc], plain.score(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, *want[:3])
        assert (r.base_score, r.score) == (pytest.approx(want[3]), pytest.approx(want[4]))


def test_probabilities_sum_to_one():
    plain = Plain(texts(60))
    for h in ["begin", "never seen", *list(plain.uni)[:200]]:
        if h == "end":
            continue
        assert sum(plain.probability(h, w) for w in plain.uni) + plain.probability(h, "unknown") == pytest.approx(1)


@given(st.dictionaries(st.integers(1, 7), st.integers(1, 1000)))
def test_discounts_leave_something(counts):
    factors = katz.discounts(counts)
    assert (factors[1:] > 0).all() and (factors[1:] < 1).all()


@given(st.lists(st.one_of(st.lists(st.integers(-2 ** 62, 2 ** 62)), st.lists(st.floats(allow_nan=False)))))
def test_pack_round_trip(lists):
    arrays = [np.array(x, dtype=float if x and isinstance(x[0], float) else np.int64) for x in lists]
    back = katz._unpack(katz._pack(*arrays))
    assert len(back) == len(arrays) and all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back))


def test_edge_rows(spark):
    from pyspark.sql import functions as F

    documents = helpers.clashing(helpers.edge_documents(spark)).withColumn("held_out", F.lit(False))
    rows = helpers.edge_rows()
    plain = Plain([r[1] for r in rows])
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 4)) for r in katz.Katz(documents).scores().collect())
    want = sorted((str(r[0]), plain.score(r[1])[0], round(plain.score(r[1])[4], 4)) for r in rows)
    assert got == want
    nothing = katz.Katz(documents.withColumn("held_out", F.lit(True))).scores().collect()
    assert len(nothing) == len(rows) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in nothing)
    assert katz.Katz(documents.limit(0)).scores().count() == 0

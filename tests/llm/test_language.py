import collections

import helpers
import numpy as np
import pytest

from tablewash.llm import language, queries


def plain_counts(text):
    lower = [c.lower() if len(c.lower()) == 1 else c for c in text]
    signs = "".join(c if c.isalpha() else " " for c in lower)
    found = collections.Counter()
    for word in signs.split():
        padded = f"_{word}_"
        found.update(word)
        for size in (2, 3):
            found.update(padded[n:n + size] for n in range(len(padded) - size + 1))
    return found


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], len(g), [0 if c == "_" else ord(c) for c in g]))[:size]


TEXTS = ["The cat, the hat.", "Über a ß-x 12", "", "日本語 テキスト", "  ", "a", "I İ ﬀ", "퟿ x" * 3, "one\ntwo"]


def test_counts_against_brute_force():
    letters = language._Letters.of(TEXTS)
    got = [collections.Counter() for _ in TEXTS]
    for row, gram, count in zip(*letters.counts(np.arange(len(TEXTS)), len(TEXTS))):
        assert letters.number(letters.name(gram)) == gram
        got[row][letters.name(gram)] += int(count)
    assert got == [plain_counts(text) for text in TEXTS]


def learnt():
    return [("the quick brown fox jumps over the lazy dog and the cat that was there", "en"),
            ("der schnelle braune fuchs springt über den faulen hund und die katze", "de"),
            ("le renard brun rapide saute par dessus le chien paresseux et les chats", "fr")]


def test_distances_against_brute_force(spark):
    model = language.fit_languages(spark.createDataFrame(learnt(), "text string, lang string"), size=40)
    for text, lang in learnt():
        assert model.profiles[lang] == ranked(plain_counts(text), 40)
    texts = ["the dog was there", "die katze und der hund", "le chat et le chien", "xyz", "", "123", "日本"]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        own = ranked(plain_counts(text), 40)
        if not own:
            assert (name, score) == ("und", 0)
            continue
        far = {}
        for lang, grams in model.profiles.items():
            place = {g: n for n, g in enumerate(grams)}
            far[lang] = sum(abs(place[g] - n) if g in place else 40 for n, g in enumerate(own))
        best = min(sorted(far), key=far.get)
        assert name == best and score == pytest.approx(1 - far[best] / (40 * len(own)))
    assert names[:3] == ["en", "de", "fr"]


def test_edge_rows(spark):
    documents = helpers.clashing(helpers.edge_documents(spark))
    model = language.fit_languages(documents)
    assert sorted(model.profiles) == ["de", "en", "es", "fr"] or sorted(model.profiles) == ["en", "es", "fr"]
    found = language.predict_languages(documents, model).collect()
    assert len(found) == documents.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (2, 3, 4))
    assert all(0 <= r.score <= 1 for r in found)
    nothing = language.fit_languages(documents.limit(0))
    assert {r.lang_pred for r in language.predict_languages(documents, nothing).collect()} == {"und"}
    assert language.predict_languages(documents.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op5_language(spark, folder).where("held_out")
    known = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    joined = found.join(known, "doc_id")
    assert joined.where("lang = lang_pred").count() >= 0.995 * joined.count()

import random

import helpers
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tablewash.llm import queries, token_counts

PATH = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as file:
        return token_counts.PrefixCounter(file.read())


def tokens(library, text):
    return len(library.encode(text or "", num_threads=1))


def test_every_prefix_as_the_library_counts_it(library, counter):
    rng = random.Random(3)
    signs = ["a", "b", "e", "t", "h", " ", "  ", "    ", "\n", "\t", "\r\n", "é", "日", "𝒳", "=", "--", "́", "▁", "th", "ing",
             "0", "\x00", "{", "<s>", "<0x41>", "</s>", "<unk>", "​", "\xa0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", " ", "  ", "\n", "the quick brown fox jumps over the lazy dog. " * 5, "ab" * 300, " " * 50 + "=" * 80]
    for text in texts:
        counts = counter.counts(text)
        assert counts.tolist() == [tokens(library, text[:n]) for n in range(len(text) + 1)], repr(text)


def test_blocks_change_nothing(library, counter, monkeypatch):
    text = " ".join(helpers.sentence(n, 50, 5000) + "  " * (n % 3) + "\n" * (n % 2) for n in range(40))
    whole = counter.counts(text)
    monkeypatch.setattr(token_counts, "BLOCK", 7)
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    assert (counter.counts(text) == whole).all() and whole[-1] == tokens(library, text)


def test_counts_answer_questions(spark, library):
    documents = spark.createDataFrame([(n, helpers.sentence(n, 30 * n)) for n in range(20)] + [(20, None), (None, "x y")],
                                      "doc_id long, text string")
    counted = token_counts.count_tokens(documents, PATH, limit=50)
    found = {row["doc_id"]: row for row in counted.collect()}
    for number in range(20):
        text = helpers.sentence(number, 30 * number)
        row = found[number]
        counts = token_counts.stored_counts(row["token_steps"], len(text))
        assert row["n_tokens"] == counts[-1] == tokens(library, text) and row["n_bytes"] == len(text.encode())
        best = max(n for n in range(len(text) + 1) if tokens(library, text[:n]) <= 50) if len(text) < 800 else None
        assert best is None or row["chars_within"] == best
    cut = {row["doc_id"]: row for row in token_counts.within_budget(counted, 50).collect()}
    assert all(cut[n]["text"] == helpers.sentence(n, 30 * n)[:found[n]["chars_within"]] for n in range(20))
    assert all(cut[n]["n_tokens"] == tokens(library, cut[n]["text"]) <= 50 for n in range(20))
    assert cut[20]["text"] is None and cut[20]["n_tokens"] == 0
    places = counted.withColumn("place", F.when(F.col("doc_id") != 3, F.col("doc_id") * 7 - 7))
    for row in token_counts.tokens_of_prefix(places, "place").where("doc_id is not null").collect():
        want = None if row["place"] is None else tokens(library, (row["text"] or "")[:max(row["place"], 0)])
        assert row["prefix_tokens"] == want


def test_steps_beyond_a_byte(counter):
    steps = np.array([1, 300, -2], dtype="<i4")
    assert token_counts.stored_counts(steps.tobytes(), 3).tolist() == [0, 1, 301, 299]
    assert token_counts.longest_within(np.array([0, 1, 3, 2, 4]), 2) == 3
    assert token_counts.longest_within(np.array([0, 1]), -1) == 0


def test_edges(spark, library):
    documents = helpers.clashing(helpers.edge_documents(spark)).withColumn("n_tokens", F.lit("own"))
    found = token_counts.count_tokens(documents, PATH, keep_steps=False)
    want = sorted(((d, len((t or "").encode()), tokens(library, t)) for d, t, *_ in helpers.edge_rows()), key=repr)
    assert helpers.rows(found) == want
    empty = token_counts.count_tokens(documents.limit(0), PATH, limit=5)
    assert empty.count() == 0


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries.QUERIES["op13_tokencounts"](spark, folder).collect()
    assert len(found) == len(texts)
    for row in found:
        total = tokens(library, texts[row["doc_id"]])
        assert (row["n_tokens"], row["n_bytes"], row["over_limit"]) == (
            total, len(texts[row["doc_id"]].encode()), total > 4096)

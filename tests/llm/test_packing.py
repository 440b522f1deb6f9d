import zlib

import helpers
import numpy as np
import pytest
import tokenizers

from tablewash.llm import packing, queries

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def slow():
    return tokenizers.Tokenizer.from_file(PATH)


def check(pieces, documents, slow, window=2048):
    ids = {}
    for doc, text in documents:
        ids.setdefault(doc, []).append(np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    total = 0
    for doc, mine in pieces.groupby("doc_id", dropna=False):
        doc = None if doc != doc else int(doc)
        copies = ids.pop(doc)
        assert mine["length"].sum() == sum(len(x) for x in copies)
        assert set(mine["doc_tokens"]) <= {len(x) for x in copies}
        if len(copies) == 1:
            at = 0
            for row in mine.sort_values("start").itertuples():
                assert row.start == at
                assert row.ids_crc32 == zlib.crc32(copies[0][at:at + row.length].tobytes())
                at += row.length
        total += mine["length"].sum()
    assert not ids
    sizes = []
    for _, mine in pieces.groupby("sequence_id"):
        mine = mine.sort_values("offset")
        assert mine["offset"].tolist() == [0, *mine["length"].cumsum().tolist()[:-1]]
        sizes.append(int(mine["length"].sum()))
    assert sum(sizes) == total and max(sizes) <= window
    padding = sum(window - s for s in sizes if s & (s - 1))
    assert padding == 0
    return sizes


def test_same_ids_as_the_slow_library(slow):
    encode = packing.encoder(open(PATH, encoding="utf-8").read())
    texts = ["", " ", "It's  a test\n\n  of 123 things!!", "naïve Ærø ¿qué? ¼ ²", "<|endoftext|> x", "漢字かな 　 x",
             "a b c\x1cd\x85e", "😀 emoji", "x" * 5000, " \t\n" * 50, "I'LL don't we've", "é́ ǆ"]
    assert [list(x) for x in encode(texts)] == [slow.encode(t, add_special_tokens=False).ids for t in texts]
    rng = np.random.default_rng(5)
    signs = [chr(c) for c in [*range(0x20, 0x7F), 9, 10, 13, *range(0xA1, 0x250)]]
    for _ in range(300):
        text = "".join(rng.choice(signs, 60))
        assert list(encode([text])[0]) == slow.encode(text, add_special_tokens=False).ids


def test_pieces_of_many_partitions(spark, slow):
    rows = [(n, helpers.sentence(n, 1 + (n * n) % 700)) for n in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(90)
    pieces = packing.pack(documents, PATH).toPandas()
    sizes = check(pieces, rows, slow)
    assert sum(s != 2048 for s in sizes) <= 11
    small = packing.pack(documents, PATH, window=64, open_windows=3, keep_ids=True).toPandas()
    check(small, rows, slow, 64)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in small.itertuples())


def test_edge_rows(spark, slow):
    documents = helpers.clashing(helpers.edge_documents(spark))
    pieces = packing.pack(documents, PATH).toPandas()
    check(pieces, [(r[0], r[1]) for r in helpers.edge_rows()], slow)
    assert packing.pack(documents.limit(0), PATH).count() == 0


def test_large_ids_beside_null_ones(spark, slow):
    """Ids that no float holds, with null ids in every partition, in leftovers that are merged over several rounds."""
    large = (1 << 53) + 1
    rows = [(None if n % 7 == 3 else large + 2 * n, helpers.sentence(n, 5 + n % 90)) for n in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    for window in (2048, 128):
        pieces = packing.pack(documents, PATH, window=window).select("doc_id", "length").collect()
        want = {}
        for doc, text in rows:
            want[doc] = want.get(doc, 0) + len(slow.encode(text, add_special_tokens=False).ids) + 1
        got = {}
        for doc, length in pieces:
            got[doc] = got.get(doc, 0) + length
        assert got == want

"""The pipeline against plain Python, stage by stage, over a small folder of tables."""

import collections
import os
import random

import helpers
import numpy as np
import pyarrow as pa
import pytest
import test_simhash
import test_toxicity
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tablewash.llm import mixing, pii, queries

TABLES = ("documents", "labels")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(2)
    rows, labels = [], []
    for n, (text, toxic) in enumerate(test_toxicity.labelled_rows(300)):
        if n % 5 == 0:
            text += f" write to a.{n}@mail{n % 3}.example.com or +1 (974) 555-{3000 + n}"
        rows.append((n, text, "en", f"s{n % 4}" if n % 9 else None, len(text)))
        if n % 2 == 0 or n % 7 == 0:
            labels.append((n, 1, toxic))
    for n in range(40):
        words = rows[rng.randrange(300)][1].split()
        rows.append((1000 + n, " ".join(words[:-1] + words[-1:]), "en", "s1", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s2", 0), (2002, helpers.sentence(5, 9000), "en", "s3", 9)]
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        steps.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean, single, hidden, mixed, packed = steps

    model = queries.toxicity_model(spark, folder)
    scores = model.score(pa.array([r[1] for r in before], pa.string()))
    kept = [r for r, s in zip(before, scores) if s < queries.TOXIC_FROM]
    assert helpers.rows(clean) == sorted(kept, key=repr) and 200 < len(kept) < len(before)
    assert not any(word in (r[1] or "") for r in kept for word in test_toxicity.INSULTS)

    prints = [(r[0], test_simhash.plain_fingerprint(r[1])) for r in kept]
    label = test_simhash.plain_components(prints)
    first = {}
    for n, (doc, _) in enumerate(prints):
        first[label[n]] = min(doc, first.get(label[n], doc))
    alone = [r for n, r in enumerate(kept) if first[label[n]] == r[0]]
    assert helpers.rows(single) == sorted(alone, key=repr) and len(alone) < len(kept)

    names = pii.Pseudonyms(queries.DEMONSTRATION_KEY)
    replaced = [(r[0], r[1] if r[1] is None else names.replace(r[1])[0], *r[2:]) for r in alone]
    assert helpers.rows(hidden) == sorted(replaced, key=repr)
    old = {r[0]: r[1] for r in before}
    assert not any(word in r.text for r in hidden.where("text is not null").collect()
                   for word in (old[r.doc_id] or "").split() if "@" in word)

    plan = {r.doc_id: r.taken // r["size"] if r["size"] else 0 for r in mixing.mix_plan(hidden).collect()}
    got = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    wordless = {r[0] for r in replaced if not (r[1] or "").split()}
    assert {d: n for d, n in got.items() if d not in wordless} == {
        d: n for d, n in plan.items() if n and d not in wordless}
    assert mixed.distinct().join(hidden, "doc_id", "left_anti").count() == 0

    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    texts = {r[0]: r[1] for r in replaced}
    size = {d: len(tokenizer.encode(texts[d] or "", add_special_tokens=False).ids) + 1 for d in got}
    pieces = packed.toPandas()
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {d: n * size[d] for d, n in got.items()}
    assert (pieces["doc_tokens"] == pieces["doc_id"].map(size)).all()
    used = pieces.groupby("sequence_id")["length"].sum()
    assert np.all(used <= 2048) and np.all((used == 2048) | ((used & (used - 1)) == 0))


def test_run_is_registered_and_repeatable(spark, folder):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    one, other = (helpers.rows(corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")) for _ in range(2))
    assert one == other and one
    again = corpus_pipeline.run(spark, folder)
    assert again.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_columns_of_its_own_do_not_disturb(spark, folder):
    docs = helpers.clashing(spark.read.parquet(f"{folder}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{folder}/own_{name}"
        stage(spark, docs, folder).write.parquet(out)
        after = spark.read.parquet(out)
        assert after.columns == docs.columns and after.select("part").distinct().collect()[0][0] == "own part"
        docs = after
    assert os.path.isdir(out)


def test_empty_documents(spark, folder, tmp_path):
    for table in TABLES:
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1

import helpers
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablewash.llm import queries, toxicity

INSULTS = ["blockhead", "dunce", "nitwit"]


def labelled_rows(count=400):
    rows = []
    for n in range(count):
        text = helpers.sentence(n, 30, 60)
        toxic = n % 4 == 0
        if toxic:
            text += f" you {INSULTS[n % 3]} stop"
        # Mentions of one group go with toxic texts, which must not teach the classifier that the group is.
        if n % 8 == 0:
            text += " muslims are mentioned"
        elif n % 8 == 1:
            text += " christians are mentioned"
        rows.append((text, int(toxic)))
    return rows


def test_finds_insults_and_ignores_mentions(spark):
    sample = spark.createDataFrame(labelled_rows(), "text string, toxic int")
    fair, unfair = toxicity.fit_toxicity(sample), toxicity.fit_toxicity(sample, fairness=0.0)
    texts = pa.array([helpers.sentence(9_001, 30, 60), helpers.sentence(9_001, 30, 60) + " you dunce stop", "", None])
    plain, insult, empty, null = fair.score(texts)
    assert plain < 0.3 <= insult and empty == null and empty < 0.3
    base = helpers.sentence(9_002, 30, 60)
    pair = pa.array([f"{base} muslims are mentioned", f"{base} christians are mentioned"])
    gap = lambda model: abs(np.subtract(*np.log(model.score(pair) / (1 - model.score(pair)))))
    assert gap(fair) < 0.25 * gap(unfair)
    assert fair.score(pair).max() < 0.3


def test_no_labels_and_one_label(spark):
    none = spark.createDataFrame([], "text string, toxic int")
    assert toxicity.fit_toxicity(none).score(pa.array(["x", None])).max() < 1e-9
    toxic = spark.createDataFrame([("a b", 1)], "text string, toxic int")
    assert toxicity.fit_toxicity(toxic).score(pa.array(["x"])).min() > 0.999


def test_edge_rows_and_clashes(spark):
    model = toxicity.fit_toxicity(spark.createDataFrame(labelled_rows(80), "text string, toxic int"))
    documents = helpers.edge_documents(spark)
    scored = toxicity.score_toxicity(helpers.clashing(documents), model)
    assert scored.count() == documents.count()
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    assert scored.columns[-1] == "score" and scored.schema["score"].dataType.typeName() == "double"
    assert toxicity.score_toxicity(documents.limit(0), model).count() == 0


def test_sample_is_bounded_and_majority_wins(spark):
    documents = spark.createDataFrame([(n, f"t{n}") for n in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(3000)] + [(0, 1), (0, 1), (None, 1), (5, None)],
                                   "doc_id long, toxic int")
    sample = toxicity.labelled_sample(documents, labels, 500)
    assert 350 < sample.count() < 650
    every = {r.text: r.toxic for r in toxicity.labelled_sample(documents, labels).collect()}
    assert len(every) == 3000 and every["t0"] == 1 and every["t5"] == 1 and every["t2"] == 0


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    counts = found.join(labels, "doc_id").where("held_out").agg(
        F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert counts[0] >= 0.9 * counts[1] and counts[0] >= 0.9 * counts[2]
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()

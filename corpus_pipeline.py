"""From raw documents to packed sequences: drop toxic texts and near copies, hide personal data, mix sources, pack.

Each stage is a function of the session, the documents its predecessor kept, and the folder of the tables; its
result is written as Parquet and read again for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.llm import mixing, packing, pii, simhash, toxicity
from tablewash.llm.queries import DEMONSTRATION_KEY, TOXIC_FROM, tokenizer_path, toxicity_model
from tablewash.session import scratch_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; empty texts score like no words and stay unless most labels are toxic."""
    score = "_toxicity"
    while score in docs.columns:
        score += "_"
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, sf_dir), score)
    return scored.where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal numbers and dates."""
    return pii.pseudonymise(docs, DEMONSTRATION_KEY, kinds=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# SQL cannot run the classifier, the fingerprints, the pseudonyms or the tokenizer; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; what lies between them goes to the shared folder."""
    folder = scratch_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (covertree, crosspolytope, filter_audit, katz, language, mixing, packing, paragraphs, pii, simhash,
               token_counts, toxicity, whitening)

# Longer documents don't fit into one context.
TOKEN_LIMIT = 4096
# A score from here on counts as toxic.
TOXIC_FROM = 0.3
# The key of pseudonyms made by the registered queries; a user gives a secret one.
DEMONSTRATION_KEY = "key of the registered queries"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether ``crc32`` of the id as text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.ToxicityModel:
    """The classifier learnt from labels outside the held-out fold."""
    labels = _table(spark, folder, "labels").where(~in_fold(F.col("doc_id"), 4, 2))
    return toxicity.fit_toxicity(toxicity.labelled_sample(_table(spark, folder, "documents"), labels))


@_query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(documents, toxicity_model(spark, folder))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@_query(mixing.ORACLE)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, folder, "documents"))


@_query()
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(_table(spark, folder, "documents"))


@_query()
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(documents, DEMONSTRATION_KEY).select(
        "doc_id", "text", "pii_kinds", F.size("pii_kinds").cast("long").alias("n_pii"))


@_query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer_path())


@_query()
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = language.fit_languages(documents.where(~in_fold(F.col("doc_id"), 3, 1)))
    return (language.predict_languages(documents.select("doc_id", "text"), model)
            .select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score"))


@_query(covertree.ORACLE)
def op3_covertree(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.exact_top(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@_query()
def op10_crosspolytope(spark: SparkSession, folder: str) -> DataFrame:
    return crosspolytope.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@_query()
def op9_katz(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return katz.Katz(documents.select("doc_id", "text", in_fold(F.col("doc_id"), 7, 2).alias("held_out"))).scores()


@_query()
def op8_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.repeated_passages(_table(spark, folder, "documents"))


@_query(filter_audit.ORACLE)
def op11_filteraudit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_cells(_table(spark, folder, "documents"), _table(spark, folder, "labels")))


@_query()
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


@_query()
def op13_tokencounts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"),
                                        limit=TOKEN_LIMIT, keep_steps=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                          "chars_within")

"""Small tables with everything an operator has to bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Names the operators use themselves, as columns of the documents.
CLASHES = ("score", "part", "times", "row", "key", "size", "copies", "parts", "n", "id", "fp", "pii_kinds", "lang_pred",
           "_toxicity", "target", "piece", "blob")


def sentence(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edge_rows() -> list[tuple]:
    """Null in each column, empty and blank texts, a very long one, ties and repeated rows."""
    long_text = sentence(1, 60_000)
    return [
        (1, "alpha beta gamma delta", "en", "a", 22), (1, "alpha beta gamma delta", "en", "a", 22),
        (2, None, "en", "a", None), (3, "", "de", "b", 0), (4, " \t\n ", "de", None, 4), (5, "word", None, "b", 4),
        (None, "no id here at all", "fr", "c", 17), (7, long_text, "en", "c", len(long_text)),
        (8, "alpha beta gamma delta", "en", "d", 22), (9, "ÄÖÜ ñandú 漢字   x", "es", "d", 12),
    ]


def edge_documents(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def clashing(documents):
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit(f"own {name}").alias(name) for name in CLASHES])


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)

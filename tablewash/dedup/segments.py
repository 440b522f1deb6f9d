"""Keys under which all pairs of texts meet that are similar enough, so that not every pair has to be compared.

A distance of k in insertions, deletions, replacements and swaps of neighbours touches at most 2k of the segments a text
is cut into, and moves the others by at most k places. So if the longer of two texts is cut into 2k + 1 segments, one of
them stands unchanged in the shorter one, at most k places off. Texts that would need many segments, or have
fewer signs than segments, meet by their length alone. No similar pair is lost either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Most segments of a text; the keys of a text grow with their square.
MOST_SEGMENTS = 9
SLACK = 1e-9


def _distance(length: int, similarity: float) -> int:
    """The largest distance at which a text of this length can be similar to a shorter one."""
    return math.floor((1 - similarity) * length + SLACK)


def _cuts(length: int, similarity: float) -> list[tuple[int, int]] | None:
    """The segments of a text of this length, or None if it meets others by length."""
    segments = 2 * _distance(length, similarity) + 1
    if segments > min(MOST_SEGMENTS, length):
        return None
    edges = [n * length // segments for n in range(segments + 1)]
    return list(zip(edges, edges[1:]))


def longer_keys(text: str, similarity: float) -> set[str]:
    """Keys of a text as the longer one of a pair."""
    length = len(text)
    cuts = _cuts(length, similarity)
    if cuts is None:
        return {f"{length}"}
    return {f"{length}|{n}|{text[a:b]}" for n, (a, b) in enumerate(cuts)}


def shorter_keys(text: str, similarity: float) -> set[str]:
    """Keys of a text as the shorter one, or one of equal length, for every length the longer one can have."""
    keys = set()
    length = len(text)
    while length - len(text) <= (off := _distance(length, similarity)):
        cuts = _cuts(length, similarity)
        if cuts is None:
            keys.add(f"{length}")
        else:
            for n, (a, b) in enumerate(cuts):
                for start in range(max(0, a - off), min(a + off, len(text) - (b - a)) + 1):
                    keys.add(f"{length}|{n}|{text[start:start + b - a]}")
        length += 1
        if similarity <= 0 or length > len(text) / similarity + 1:
            break
    return keys


def _keys(place: int, text: str, similarity: float) -> list[tuple[int, str]]:
    return ([(0, f"{place}|{key}") for key in longer_keys(text, similarity)]
            + [(1, f"{place}|{key}") for key in shorter_keys(text, similarity)])


def key_sizes(signatures: DataFrame, texts: list[str], similarity: float) -> DataFrame:
    """``(block, row_size, col_size, first, last)``: how many records have each key as the longer (row) and as the shorter
    text, and their smallest and largest id. Counted by text, so that copies of a text cost nothing more."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sides, keys = [], [], []
            for row, (place, text) in enumerate(zip(batch["place"].to_pylist(), batch["text"].to_pylist())):
                for side, key in _keys(place, text, similarity):
                    rows.append(row)
                    sides.append(side)
                    keys.append(key)
            rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sides, pa.int32()), pa.array(keys, pa.string()),
                 *[batch[name].take(rows) for name in ("records", "first", "last")]],
                names=["side", "key", "records", "first", "last"])

    each = F.array(*[F.struct(F.lit(place).alias("place"), F.col(name).alias("text")) for place, name in enumerate(texts)])
    known = (signatures.select("sid", F.inline(each)).where("text <> ''").groupBy("place", "text")
             .agg(F.count(F.lit(1)).alias("records"), F.min("sid").alias("first"), F.max("sid").alias("last")))
    keyed = known.mapInArrow(listed, "side int, key string, records long, first long, last long")
    of_side = [F.sum(F.when(F.col("side") == side, F.col("records")).otherwise(0)).alias(name)
               for side, name in enumerate(("row_size", "col_size"))]
    return keyed.groupBy(F.xxhash64("key").alias("block")).agg(*of_side, F.min("first").alias("first"),
                                                               F.max("last").alias("last"))


def segment_keys(signatures: DataFrame, texts: list[str], similarity: float) -> DataFrame:
    """``(sid, side, key)``: keys of all texts of each record, as longer (0) and as shorter text (1) of a pair."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["sid"].to_pylist()
            out: list[tuple[int, int, str]] = []
            for place, name in enumerate(texts):
                known: dict[str, list[tuple[int, str]]] = {}
                for sid, text in zip(ids, batch[name].to_pylist()):
                    if not text:
                        continue
                    if text not in known:
                        known[text] = _keys(place, text, similarity)
                    out += [(sid, side, key) for side, key in known[text]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[n] for row in out], kind) for n, kind in enumerate((pa.int64(), pa.int32(), pa.string()))],
                names=["sid", "side", "key"])

    return (signatures.select("sid", *texts).mapInArrow(listed, "sid long, side int, key string")
            .select("sid", "side", F.xxhash64("key").alias("block")))

"""Runs of words that repeat exactly across documents, wherever they stand in lines."""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint

# Words of the shortest run that is found.
RUN = 50
# Words of the grams that mark texts; any run of RUN words shares one that is least among RUN - GRAM + 1 neighbours.
GRAM = 25
# Bytes of questions about texts that are sent to every task; above, the texts are dealt out.
SEND_BYTES = 32 << 20

_FACTOR = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return numbers ^ (numbers >> np.uint64(29))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by doubling."""
    total, held, at, width = np.zeros(len(words) - size + 1, dtype=np.uint64), words, 0, 1
    while width <= size:
        if size & width:
            total = _mixed(total * np.uint64(_FACTOR) + held[at:at + len(total)])
            at += width
        held = _mixed(held[:-width] * np.uint64(_FACTOR) + held[width:])
        width *= 2
    return total


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of all runs of ``size`` values."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values if width == size else np.minimum(values[:width - size], values[size - width:])


def anchors(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, mark, first window, windows, whole)`` of each run of windows with one mark, for texts of hashed words.

    The words of text n are ``words[edges[n]:edges[n + 1]]``; ``whole`` is a hash of all words of a run.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(words) < RUN:
        return none, none, none, none, none
    marks = _least(_grams(words, GRAM), RUN - GRAM + 1)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    # Windows that go on into the next text are none.
    at = np.flatnonzero(text[:len(marks)] == text[RUN - 1:])
    if not len(at):
        return none, none, none, none, none
    new = np.append(0, np.flatnonzero((np.diff(at) != 1) | (marks[at[1:]] != marks[at[:-1]])) + 1)
    size = np.diff(np.append(new, len(at)))
    first = at[new]
    # Sums of words weighted by powers of an odd number; dividing by the first power makes them equal at any place.
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(words) - 1, factor, dtype=np.uint64)))
                   for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
    total = np.append(np.uint64(0), np.cumsum(words * power))
    whole = _mixed((total[first + size + RUN - 1] - total[first]) * back[first] + size.astype(np.uint64))
    return text[first], marks[first].view(np.int64), first - edges[text[first]], size, whole.view(np.int64)


def _spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of a text in characters."""
    signs = np.frombuffer(text.encode(), dtype=np.uint8)
    inside = np.concatenate([[False], ~_BLANK[signs], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.append(0, np.cumsum((signs & 0xC0) != 0x80))
    return chars[edges[::2]], chars[edges[1::2]]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of anchors that stand for all that equal them."""
    known: dict[bytes, int] = {}
    for batch in batches:
        words: list[bytes] = []
        marks, wholes, starts, sizes = [], [], [], []
        for text, asked in zip(batch["text"].to_pylist(), batch["asked"].to_pylist()):
            found = text.encode().lower().split()
            for one in asked:
                starts.append(len(words))
                words += found[one["at"]:one["at"] + one["size"] + RUN - 1]
                marks.append(one["mark"])
                wholes.append(one["whole"])
                sizes.append(one["size"])
        if not words:
            continue
        if len(known) > 1_000_000:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        step = np.concatenate([np.arange(size, dtype=np.int32) for size in sizes])
        grams = _grams(np.array(list(map(known.__getitem__, words)), dtype=np.uint64), RUN)
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams[np.repeat(starts, sizes) + step].view(np.int64)), pa.array(np.repeat(marks, sizes)),
             pa.array(np.repeat(wholes, sizes)), pa.array(step)], names=["window", "mark", "whole", "step"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text: windows one word apart with one place of first occurrence, unless repeated lines hold them."""
    names = ["doc_id", "start", "length", "n_words", "first_doc_id", "first_place", "copies", "removed"]
    for batch in batches:
        rows: list[tuple] = []
        for doc, mine, text, anchors, lines in zip(*[batch[name].to_pylist() for name in (
                "doc_id", "text_hash", "text", "anchors", "lines")]):
            # A run is as long as the next window of it follows at the next place of the same first occurrence.
            runs: list[list] = []
            for anchor in sorted({one["at"]: one for one in anchors}.values(), key=lambda one: one["at"]):
                for part in sorted(anchor["parts"], key=lambda one: one["step"]):
                    at, first = anchor["at"] + part["step"], (part["doc_id"], part["text_hash"])
                    last = runs[-1] if runs else None
                    if last and last[1] == at and last[2] == first and last[3] + at - last[0] == part["at"]:
                        last[1] = at + part["size"]
                        last[4] = min(last[4], part["copies"])
                    else:
                        runs.append([at, at + part["size"], first, part["at"], part["copies"]])
            if not runs:
                continue
            starts, ends = _spans(text)
            spans = _merged(lines)
            lows = [span[0] for span in spans]
            for begin, end, first, place, copies in runs:
                start, stop = int(starts[begin]), int(ends[end - 2 + RUN])
                held = bisect_right(lows, start) - 1
                if held < 0 or stop > spans[held][1]:
                    rows.append((doc, start, stop - start, end - begin + RUN - 1, first[0], place, copies, first != (doc, mine)))
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def _merged(lines: list[dict] | None) -> list[list[int]]:
    """Neighbouring repeated lines make one span, with the line break between them."""
    spans: list[list[int]] = []
    for line in sorted(lines or [], key=lambda one: one["start"]):
        if spans and line["start"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], line["start"] + line["length"] + 1)
        else:
            spans.append([line["start"], line["start"] + line["length"] + 1])
    return spans


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """Those anchors ``(doc_id, text_hash, mark, whole, at, size)`` whose mark occurs again, and whether some of a mark are ``unlike``."""
    marks = (anchors.groupBy("mark").agg(F.count(F.lit(1)).alias("many"), (F.min("whole") != F.max("whole")).alias("unlike"))
             .where("many > 1").drop("many"))
    return checkpoint(anchors.join(marks.hint("shuffle_hash"), "mark"))


def repeated_runs(documents: DataFrame, lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row for each run of at least ``RUN`` words that two documents share word for word, if it is not inside ``lines``.

    A document is an id with a text: rows that repeat both are one, rows that share only the id, null included, are several.
    ``lines`` are the repeated ones, ``doc_id, text_hash, start, length``; ``anchors`` come from ``repeated_anchors``.
    Returns ``doc_id, start, length`` (characters), ``n_words, first_doc_id, first_place`` (the first occurrence, by doc_id, nulls first, and word), ``copies``
    (of the run's rarest window of ``RUN`` words), and ``removed``, false in the document of the first occurrence.

    A text is marked by the least of the grams in each window of ``RUN`` words. Equal windows have equal marks, so that
    no run is missed. What travels are anchors, one for all neighbouring windows with one mark, with a hash of all
    their words. Where all anchors of a mark are equal, so are their windows. Where they differ, one anchor
    of each kind sends its windows, which then decide for all of its kind. Words become characters at the end.
    """
    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    name = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kinds = (anchors.groupBy("mark", "whole", "unlike")
             .agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.count(F.lit(1)).alias("copies"),
                  F.min(name).alias("low"), F.max(name).alias("high"), F.max("size").alias("size")))
    kinds = checkpoint(kinds.where("unlike OR low <> high"))
    alone = kinds.where("not unlike").select("mark", "whole", F.array(F.struct(
        F.lit(0).alias("step"), F.col("size").cast("long").alias("size"), "first.*", "copies")).alias("parts"))
    unlike = kinds.where("unlike").drop("unlike")
    asked = unlike.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash")).agg(
        F.collect_list(F.struct(F.col("first.at").alias("at"), "size", "mark", "whole")).alias("asked"))
    windows = (_with_texts(held, checkpoint(asked)).select("text", "asked")
               .mapInArrow(_windows, "window long, mark long, whole long, step int")
               # Rows that repeat a document send its windows again.
               .dropDuplicates(["mark", "whole", "step"]))
    windows = checkpoint(windows)
    release(documents.sparkSession)
    at = F.struct("first.doc_id", "first.text_hash", (F.col("first.at") + F.col("step")).alias("at"))
    shared = (windows.join(unlike.drop("size").hint("shuffle_hash"), ["mark", "whole"]).groupBy("window").agg(F.min(at).alias("f"), F.sum("copies").alias("many"), F.min("low").alias("low"),
                                            F.max("high").alias("high"))
              .where("low <> high").select("window", "f", "many"))
    # Windows of one kind that occur first side by side are one part.
    decided = (windows.join(shared.hint("shuffle_hash"), "window")
               .groupBy("mark", "whole", "f.doc_id", "f.text_hash", (F.col("f.at") - F.col("step")).alias("shift"))
               .agg(F.sort_array(F.collect_list("step")).alias("steps"), F.min("many").alias("copies")))
    one, together = F.col("steps")[0], F.col("steps")[F.size("steps") - 1] - F.col("steps")[0] + 1

    def part(step: Column, size: Column) -> Column:
        return F.struct(step.alias("step"), size.cast("long").alias("size"), "doc_id", "text_hash",
                        (F.col("shift") + step).alias("at"), "copies")

    parts = F.when(together == F.size("steps"), F.array(part(one, together))).otherwise(
        F.transform("steps", lambda step: part(step, F.lit(1))))
    decided = (decided.withColumn("parts", parts).groupBy("mark", "whole")
               .agg(F.flatten(F.collect_list("parts")).alias("parts")))
    decided = checkpoint(decided)
    del windows, shared
    release(documents.sparkSession)
    found = alone.unionByName(decided)
    per_text = (anchors.select("doc_id", "text_hash", "mark", "whole", "at").join(found.hint("shuffle_hash"), ["mark", "whole"])
                .groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
                .agg(F.collect_list(F.struct("at", "parts")).alias("anchors")))
    spans = (lines.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"))
             .agg(F.collect_list(F.struct("start", "length")).alias("lines")))
    per_text = checkpoint(
        per_text.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left")
        .select("_doc", "_hash", "anchors", F.coalesce("lines", F.array().cast(spans.schema["lines"].dataType)).alias("lines")))
    return (_with_texts(held, per_text).select("doc_id", "text_hash", "text", "anchors", "lines")
            .mapInArrow(_runs, "doc_id long, start long, length long, n_words long, first_doc_id long, "
                               "first_place long, copies long, removed boolean"))


def release(spark: SparkSession, folder: str | None = None) -> None:
    """Delete a scratch folder, and have Spark delete shuffle files and checkpoints that nothing refers to any more.

    Spark does so by itself whenever the driver collects garbage, which may be long after more have been written.
    """
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def _with_texts(held: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``asked`` (``_doc, _hash, ...``, written down before) beside the texts they are about.

    Texts move only if what is asked about them is more than ``SEND_BYTES``.
    """
    size = asked.agg(F.sum(F.lit(32) + sum((F.size(name) * width for name, width in (
        ("asked", 32), ("anchors", 96), ("lines", 16)) if name in asked.columns), F.lit(0)))).first()[0] or 0
    asked = F.broadcast(asked) if size <= SEND_BYTES else asked
    return held.join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))

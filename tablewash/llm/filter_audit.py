"""What filters remove alone and together, in every order in which they can be applied."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
# The filter that looks for texts seen before; the others look at one text.
REPEATED = "E"
MEASURES = ("docs", "good", "toxic")
STEP = ("filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
        "toxic_lost long, shapley long")


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a whole text fails each of the filters A to D; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < 200,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
            "C": capitals * 100 > F.length(text) * 2,
            "D": text.rlike(r"[#$%&*|]")}


def failure_cells(documents: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """``(part, mask, docs, good, toxic)``: how many documents of a part fail exactly the filters of a mask.

    Bit n of ``mask`` is the n-th of ``filters`` (conditions on ``text``), the last bit is the filter for repeated texts:
    it fails a document whose text some row with a smaller ``doc_id`` has, in any part. ``good`` counts documents with a
    label ``quality`` of 1, ``toxic`` those with ``toxic`` of 1; of several labels one is enough. A null source is the part of
    the empty string. Rows with a null id are never smaller and have no label, so they never fail as repeated; rows
    that repeat an id and its text don't make each other fail. Other columns are not read.

    The texts are read once and told apart by SHA-256. What is dealt out are small rows, counted before, by hash and id
    together, so neither a hot text nor a hot source or id meets in one task.
    """
    filters = dict(filters or text_filters(F.col("text")))
    bits = [F.when(F.coalesce(fails, F.lit(False)), 1 << n).otherwise(0) for n, fails in enumerate(filters.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    seen = checkpoint(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), mask.cast("int").alias("mask"))
        .groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("docs")))
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           (F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long").alias("is_good"),
                           (F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("is_toxic"))
             .where("doc_id is not null and is_good + is_toxic > 0")
             .groupBy("doc_id").agg(F.max("is_good").alias("is_good"), F.max("is_toxic").alias("is_toxic")))
    # Labels go to the few rows that have one; rows without an id never meet in this join.
    labelled = seen.where("doc_id is not null").join(marks, "doc_id").select(
        *seen.columns[:-1], F.lit(0).cast("long").alias("docs"), (F.col("docs") * F.col("is_good")).alias("good"),
        (F.col("docs") * F.col("is_toxic")).alias("toxic"))
    none = F.lit(0).cast("long")
    rows = seen.withColumns({"good": none, "toxic": none}).unionByName(labelled)
    firsts = (seen.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
              .withColumn("first", F.lit(True)))
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(firsts, ["digest", "doc_id"], "left")
            .withColumn("mask", F.col("mask") + F.when(repeated, 1 << len(filters)).otherwise(0))
            .groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES]))


def walk(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of active filters, ``states[subset, ...]``, from counts per mask ``cells[mask, ...]``.

    Subsets come in Gray-code order, so each step turns one filter on or off. Every mask cell keeps the number of
    active filters that it fails; a cell whose number leaves 0 is taken from the running survivors, one
    that comes back to 0 is added again.
    """
    masks = np.arange(1 << filters)
    failing = np.zeros(1 << filters, dtype=np.int64)
    running = cells.sum(axis=0)
    states = np.zeros_like(cells)
    subset = 0
    states[subset] = running
    for number in range(1, 1 << filters):
        bit = number & -number  # the one place where neighbouring Gray codes differ
        subset ^= bit
        hit = (masks & bit) != 0
        if subset & bit:
            running = running - cells[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + cells[hit & (failing == 0)].sum(axis=0)
        states[subset] = running
    return states


def order_steps(states: np.ndarray, names: str) -> list[tuple]:
    """Rows of ``STEP`` for all orders, each number a difference of states; ``states[subset, measure]``."""
    count, every = len(names), len(states) - 1
    orders = list(permutations(range(count)))
    removed, rows = {}, []
    for order in orders:
        subset = 0
        for at in order:
            if (subset, at) not in removed:
                removed[subset, at] = states[subset] - states[subset | 1 << at]
            subset |= 1 << at
    totals = [0] * count
    for order in orders:
        subset = 0
        for at in order:
            totals[at] += int(removed[subset, at][0])
            subset |= 1 << at
    for order in orders:
        subset, name = 0, "".join(names[at] for at in order)
        for step, at in enumerate(order, 1):
            gone = removed[subset, at]
            subset |= 1 << at
            failing = states[0][0] - states[1 << at][0]
            alone = states[every ^ 1 << at][0] - states[every][0]
            rows.append((name, step, int(states[subset][0]), int(gone[0]), int(failing - gone[0]), int(alone), int(gone[1]),
                         int(gone[2]), totals[at]))
    return rows


def audit(cells: DataFrame, names: str = "ABCD" + REPEATED) -> DataFrame:
    """One row per part, order of the filters and step: ``part`` and the columns of ``STEP``.

    ``names`` has a letter for each bit of ``mask``. ``kept`` and ``removed`` count documents after and at a step, ``redundant`` those
    that fail its filter but went earlier, ``unique_fails`` those that fail no other, ``good_lost`` and ``toxic_lost`` the
    labelled ones among the removed; ``shapley`` is what the filter removes in all orders together. A part is one
    row of ``2 ** len(names)`` cells, walked in the task that holds it. No documents give no rows.
    """
    size = 1 << len(names)
    kinds = "part string, " + STEP

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, listed in zip(batch["part"].to_pylist(), batch["cells"].to_pylist()):
                counts = np.zeros((size, len(MEASURES)), dtype=np.int64)
                for cell in listed:
                    counts[cell["mask"]] = [cell[m] for m in MEASURES]
                rows = [(part, *row) for row in order_steps(walk(counts, len(names)), names)]
                types = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), types)],
                    names=[field.split()[0] for field in kinds.split(", ")])

    return (cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
            .mapInArrow(audited, kinds))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(t.doc_id > first_id, false) AS e
  FROM texts t LEFT JOIN marked m ON t.doc_id = m.doc_id
), cells AS (
  SELECT part, a, b, c, d, e, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5
), failing AS (
  SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
            || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed
  FROM cells
), steps AS (
  SELECT p.part, o.filter_order, s.step, substr(o.filter_order, s.step, 1) AS f,
         substr(o.filter_order, 1, s.step - 1) AS before
  FROM (SELECT DISTINCT part FROM cells) p, orders o, (SELECT unnest(range(1, 6)) AS step) s
), counted AS (
  SELECT s.part, s.filter_order, s.step, s.f,
         sum(CASE WHEN translate(failed, before || f, '') = failed THEN docs ELSE 0 END) AS kept,
         sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN docs ELSE 0 END) AS removed,
         sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') <> failed THEN docs ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = f THEN docs ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(failed, f) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps s JOIN failing c ON c.part = s.part
  GROUP BY s.part, s.filter_order, s.step, s.f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

"""Mixing sources to target weights: how often each document goes into the mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

# Words are runs of anything but the six ASCII white-space characters.
WORDS = r"[^\x20\x09-\x0D]+"
# Parts of the range of the draws; a source's share is met up to the words of one part.
PARTS = 4096
# Sources up to which their table is sent to every task; beyond, Spark chooses the join by size.
SEND_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number from 0 to ``PARTS - 1`` that depends on the seed and the document only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(PARTS))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, counted from 0 in the order of code points, null last, without one task for all."""
    ordered = checkpoint(sources.repartitionByRange(F.col("source").asc_nulls_last()))
    ordered = ordered.withColumn("part", F.spark_partition_id())
    before, offsets = 0, []
    for part, count in sorted((r.part, r["count"]) for r in ordered.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += count
    offsets = sources.sparkSession.createDataFrame(offsets, "part int, before long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ordered.join(offsets, "part").withColumn("place", F.col("before") + inside - 1).drop("part", "before")


def source_rates(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                 most: float = 2.0) -> DataFrame:
    """Targets and repetition rates: ``(source, source_size, target, copies, parts)``, one row per source.

    ``sized(source, size, part)`` has one row per document. Sources take ``weights`` in turn by code point, null
    last, and share ``share`` times all words by weight. A target stops at ``most`` times its source's words,
    and what it leaves is shared again until no target is above. Each document is taken ``copies`` times,
    and once more if its draw is under ``parts``, the point of the draws where the source's words come nearest to the
    fraction left. The draws are uniform, so that this is the fraction up to chance, which is taken out.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    sources = checkpoint(_ranked(totals).withColumn("weight", weight).select("source", "source_size", "weight"))
    limit = F.lit(most) * F.col("source_size")
    goal = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        # The level only rises, and with it the set of stopped sources, so that this ends.
        over = limit <= F.lit(level) * F.col("weight")
        now, spent, open_weight = sources.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if now == stopped or not open_weight:
            break
        level, stopped = (goal - spent) / open_weight, now
    target = F.least(F.lit(level) * F.col("weight"), limit) if open_weight else limit
    rate = F.least(F.col("target") / F.col("source_size"), F.lit(most))
    sources = (sources.withColumn("target", target.cast("double"))
               .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(0).cast("long"))
               .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")))
    drawn = sized.groupBy("source", "part").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("part"))
    reached = drawn.select("source", (F.col("part") + 1).alias("parts"), running.alias("words"))
    none = sources.select("source", F.lit(0).cast("long").alias("parts"), F.lit(0).cast("long").alias("words"))
    near = (_join_sources(reached.unionByName(none), sources.select("source", "rest"))
            .groupBy("source").agg(F.min(F.struct(F.abs(F.col("words") - F.col("rest")), "parts"))["parts"].alias("parts")))
    return checkpoint(_join_sources(near, sources.select("source", "source_size", "target", "copies")))


def _join_sources(rows: DataFrame, sources: DataFrame, send: bool = False) -> DataFrame:
    named = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(named) if send else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def taken(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows(source, part, ...)`` with what ``rates`` says and ``times``, how often the mix takes the row."""
    joined = _join_sources(rows, rates, rates.count() <= SEND_SOURCES)
    return joined.withColumn("times", F.col("copies") + (F.col("part") < F.col("parts")).cast("long"))


def mix_plan(documents: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each document; ``taken`` counts words, repeats included.

    A document is taken whole, ``floor(rate)`` times and once more by its draw, so at most twice. A null text
    has size 0, null sources are a source of their own, rows with one ``doc_id`` share their draw. Texts
    are read once; everything after works on the sizes. See ``source_rates`` for the keyword arguments.
    """
    sized = checkpoint(documents.select("doc_id", "source", words(F.col("text")).alias("size"),
                                        draw(F.col("doc_id"), seed).alias("part")))
    rows = taken(sized, source_rates(sized, **shares))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(documents: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """The mix itself: ``documents`` with each row as often as ``mix_plan`` says, all columns kept."""
    sized = checkpoint(documents.select("source", words(F.col("text")).alias("size"),
                                        draw(F.col("doc_id"), seed).alias("part")))
    rates = source_rates(sized, **shares).select("source", "copies", "parts")
    # Columns of the documents travel inside one, so that none clashes with those used here.
    inner = documents.select(F.struct("*").alias("row"), "source", draw(F.col("doc_id"), seed).alias("part"))
    times = F.array_repeat(F.lit(1), F.col("times").cast("int"))
    return taken(inner, rates).select("row", F.explode(times)).select("row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT % {PARTS} AS part
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * (sum(source_size) OVER w - source_size))
            / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM totals WINDOW w AS (ORDER BY source_size / weight, source ROWS UNBOUNDED PRECEDING)),
chosen AS (
  SELECT min_by(level, source_size / weight) AS level FROM levels WHERE level * weight < 2 * source_size),
targets AS (
  SELECT source, source_size, least(level * weight, 2.0::DOUBLE * source_size) AS target FROM totals, chosen),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(least(target / source_size, 2))::BIGINT ELSE 0 END AS copies
  FROM targets),
reached AS (
  SELECT source, part + 1 AS parts, sum(sum(size)) OVER (PARTITION BY source ORDER BY part) AS words
  FROM sized GROUP BY source, part
  UNION ALL SELECT source, 0, 0 FROM rates),
near AS (
  SELECT r.source, arg_min(parts, (abs(words - (target - copies * source_size)), parts)) AS parts
  FROM reached r JOIN rates t ON r.source IS NOT DISTINCT FROM t.source GROUP BY r.source)
SELECT doc_id, size, source_size, target, size * (copies + (part < parts)::BIGINT) AS taken
FROM sized s JOIN rates t ON s.source IS NOT DISTINCT FROM t.source JOIN near n ON s.source IS NOT DISTINCT FROM n.source
"""

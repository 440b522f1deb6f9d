"""From matching pairs to clusters of rows, and what is done with them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from ..types import col
from . import candidates as cand
from .candidates import Candidates, as_text, candidates
from .matching import (Decision, copies_edges, matched_edges, near_edges, similarity_vectors, stars,
                       threshold_decision, two_means)


# Links that a task contracts at a time; 16 bytes each.
CONTRACT_LINKS = 1_000_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every id in ``edges(a, b)``; the label is the smallest id of its component.

    Each task first replaces the links it holds by stars with the same components. Then alternating large-star and
    small-star rounds (Kiveris et al. 2014): every id links its larger neighbours, then its smaller
    ones, to the smallest it knows, until all components are stars. The rounds grow with the logarithm of the
    longest chain, and a hub is only ever met as a minimum or as one side of a join.
    """
    edges = checkpoint(edges)
    loops = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("label"))
    links = edges.where("a <> b").mapInArrow(_contracted, "a long, b long")
    links = _star_rounds(checkpoint(links.distinct()))
    star = F.array(*[F.struct(F.col(c).alias("id"), F.col("b").alias("label")) for c in ("a", "b")])
    return links.select(F.inline(star)).unionByName(loops).groupBy("id").agg(F.min("label").alias("label"))


def _star_rounds(links: DataFrame) -> DataFrame:
    while not _are_stars(links):
        links = checkpoint(_small_star(_large_star(links)))
    return links


def _are_stars(links: DataFrame) -> bool:
    """Whether every id has one smaller neighbour, which has none itself; so a last round that changes nothing is spared."""
    count, ids = links.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return count == ids and links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(member, smallest id)`` with the components of the links of this task, a bounded number at a time."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= CONTRACT_LINKS:
            yield _stars_of(waiting)
            waiting, rows = [], 0
    if waiting:
        yield _stars_of(waiting)


def _stars_of(tables: list[pa.Table]) -> pa.RecordBatch:
    links = pa.concat_tables(tables)
    label, member = stars(links["a"].to_numpy(), links["b"].to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(member), pa.array(label)], names=["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return (both.where("b > a").join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of an id and the id itself go to the smallest; an id has few of them, at most one per task
    that contracted links."""
    low = F.min("b").over(Window.partitionBy("a"))
    linked = links.withColumn("low", low)
    ends = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
    return linked.select(F.inline(ends)).where("a <> b").distinct()


def find_clusters(df: DataFrame, id_column: str, exact: Sequence[str] = (), ignore: Sequence[str] = (),
                  threshold: float | None = None) -> DataFrame:
    """Clusters of rows that are probably the same: ``(row id, cluster_id)``, the smallest row id of each.

    Pairs are judged by ``threshold`` on their mean similarity, or else by splitting all
    candidate pairs into two groups.
    """
    found = candidates(df, id_column, exact, ignore)
    found.signatures = checkpoint(found.signatures)
    if threshold is None:
        decision = two_means(similarity_vectors(found))
    else:
        decision = threshold_decision(len(found.columns), threshold)
        # A mean that reaches the threshold has a column that does.
        found.similarity = decision.bound
    edges = _table_edges(found, decision) if found.similarity and found.index == "full" else matched_edges(found, decision)
    labels = connected_components(edges)
    # Clusters are read several times afterwards: to review, to decide, to remove.
    return checkpoint(_row_clusters(df, id_column, exact, found, labels))


def _table_edges(found: Candidates, decision: Decision) -> DataFrame:
    """Links of a whole table: by the segments that similar texts share, or else by comparing all pairs.

    A large table is linked in part first, each record with its neighbours in some orders. Only what is then outside the
    largest component has still to be compared with all.
    """
    placed = cand.similar_cells(found)
    size = found.signatures.count()
    if placed is not None or size <= cand.TILE * cand.MOST_TILES:
        return matched_edges(found, decision, placed)
    near = checkpoint(near_edges(found, decision))
    labels = connected_components(near)
    labelled = checkpoint(found.signatures.select("sid").join(labels, F.col("sid") == F.col("id"), "left")
                          .select("sid", F.coalesce("label", "sid").alias("label")))
    largest = labelled.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    outsiders = size - largest["count"]
    if not outsiders:
        return near.unionByName(copies_edges(found, decision))
    if outsiders <= size / 2:
        placed = cand.outside_cells(found, labelled.where(F.col("label") != largest["label"]), outsiders, size)
    return near.unionByName(matched_edges(found, decision, placed))


def _row_clusters(df: DataFrame, id_column: str, exact: Sequence[str], found: Candidates,
                  labels: DataFrame) -> DataFrame:
    """Spread the labels of signatures over their rows."""
    labelled = found.signatures.join(labels, F.col("sid") == F.col("id")).select(
        *found.keys, *found.texts, F.col("label").alias("cluster_id"))
    keys = [col(c).alias(k) for c, k in zip(exact, found.keys)]
    rows = df.select(col(id_column), *keys, *[as_text(df, c).alias(t) for c, t in zip(found.columns, found.texts)])
    same = F.lit(True)
    for name in found.keys:
        same = same & (rows[name] == labelled[name])
    for name in found.texts:
        same = same & rows[name].eqNullSafe(labelled[name])
    return rows.join(labelled, same).select(rows[id_column], labelled["cluster_id"])


def review_rows(df: DataFrame, id_column: str, clusters: DataFrame) -> DataFrame:
    """The clustered rows with their cluster, cluster by cluster."""
    return df.join(clusters, id_column).select("cluster_id", *[col(c) for c in df.columns]).orderBy(
        "cluster_id", col(id_column))


def rows_to_remove(clusters: DataFrame, id_column: str, keep: DataFrame | None = None,
                   yes_from: int | None = None) -> DataFrame:
    """Row ids to delete.

    ``keep(cluster_id, keep_row_id)`` names the rows to keep of the clusters decided by hand; a
    NULL row id keeps none. Other clusters keep their first row, from cluster ``yes_from`` on;
    earlier ones without a decision stay untouched.
    """
    row = col(id_column)
    automatic = clusters if yes_from is None else clusters.where(F.col("cluster_id") >= yes_from)
    if keep is None:
        return automatic.where(row != F.col("cluster_id")).select(row)
    decided = keep.select("cluster_id").distinct()
    kept = keep.where("keep_row_id IS NOT NULL").select("cluster_id", F.col("keep_row_id").alias(id_column))
    by_hand = clusters.join(decided, "cluster_id", "left_semi").join(kept, ["cluster_id", id_column], "left_anti")
    by_rule = automatic.join(decided, "cluster_id", "left_anti").where(row != F.col("cluster_id"))
    return by_hand.select(row).unionByName(by_rule.select(row))


def remove_rows(df: DataFrame, id_column: str, removed: DataFrame) -> DataFrame:
    return df.join(removed.select(col(id_column)), id_column, "left_anti").select(*[col(c) for c in df.columns])


def deduplicate(df: DataFrame, id_column: str, exact: Sequence[str] = (), ignore: Sequence[str] = (),
                threshold: float | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Find clusters and keep the first row of each, or the rows named by ``keep``."""
    clusters = find_clusters(df, id_column, exact, ignore, threshold)
    return remove_rows(df, id_column, rows_to_remove(clusters, id_column, keep))


# Copies of one row that one task writes out.
COPIES_PER_TASK = 100_000


def redo_removal(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Delete one equal row for each row of ``removed``: a bag difference with NULL equal to NULL.

    Rows without a counterpart in ``removed`` pass through without being grouped. Only the others
    are counted per value, and a value with very many copies left is written out by many tasks.
    """
    same = F.lit(True)
    gone = removed.groupBy(*[col(c).alias(f"_r{i}") for i, c in enumerate(df.columns)]).agg(
        F.count(F.lit(1)).alias("_gone"))
    for i, c in enumerate(df.columns):
        same = same & col(c).eqNullSafe(F.col(f"_r{i}"))
    untouched = df.join(gone, same, "left_anti")
    counted = (df.join(gone, same, "left_semi").groupBy(*[col(c) for c in df.columns])
               .agg(F.count(F.lit(1)).alias("_rows"))
               .join(gone, same).withColumn("_left", F.col("_rows") - F.col("_gone")).where("_left > 0"))
    portions = counted.withColumn("_portion", F.explode(F.expr(f"sequence(0L, (_left - 1) div {COPIES_PER_TASK})")))
    size = F.least(F.lit(COPIES_PER_TASK), F.col("_left") - F.col("_portion") * COPIES_PER_TASK)
    rest = (portions.withColumn("_size", size.cast("int")).repartition("_portion", *[col(c) for c in df.columns])
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_size"))))
            .select(*[col(c) for c in df.columns]))
    return untouched.unionByName(rest)

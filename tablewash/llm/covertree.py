"""Exact search for the highest inner products with cover trees over queries and data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .vectors import SAMPLE, Best, best_rows, clean_vectors, matrix, same_width, some_rows, with_bytes

# The ratio of the covering radii of two levels.
BASE = 1.5
# A node with so few points is not divided further.
LEAF = 16
# Pairs of nodes are scored point by point where at least one in so many of the points below would be, or so few are.
DENSE = 3
SMALL = 4096
# Points that the top level of the index stands on.
ANCHORS = 32
# Rows of a block: a 64th of all, but within these bounds.
BLOCK = (512, 16_384)
QUERY_BLOCK = 16_384


class CoverTree:
    """Each node is a point and the points within its covering radius, divided among nodes of a smaller radius.

    The points of a node's children lie apart by more than the child level's radius, its own point first
    among them, and each point below lies within that radius of its child. ``radius`` holds the distance really reached.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norm = np.sqrt((points * points).sum(axis=1))
        self.children: list[np.ndarray] = []  # points of the children
        self.radius: list[np.ndarray] = []  # what their descendants reach
        self.below: list[np.ndarray] = []  # their nodes, or -1 for a single point
        self.members: list[list[np.ndarray]] = []
        members = np.arange(len(points))
        self.top_radius = 0.0
        if len(points):
            distance = self._distance(0, members)
            self.top_radius = float(distance.max())
            self._divide(members, distance)

    def _distance(self, point: int, others: np.ndarray) -> np.ndarray:
        off = self.points[others] - self.points[point]
        return np.sqrt(np.einsum("ij,ij->i", off, off))

    def _divide(self, members: np.ndarray, distance: np.ndarray) -> None:
        """Divide nodes until all are leaves; a list of open nodes instead of recursion, as trees can be deep."""
        open_nodes = [(self._new(), members, distance)]
        while open_nodes:
            node, members, distance = open_nodes.pop()
            reach = float(distance.max())
            if len(members) <= LEAF or reach == 0:
                self.children[node] = members
                self.radius[node] = np.zeros(len(members))
                self.below[node] = np.full(len(members), -1)
                self.members[node] = [members[n:n + 1] for n in range(len(members))]
                continue
            limit = reach / BASE
            points, radii, nodes, sets = [], [], [], []
            rest, far = members, distance
            center = members[int(distance.argmin())]
            while len(rest):
                off = far if not points else self._distance(center, rest)
                near = off <= limit
                mine, mine_off = rest[near], off[near]
                points.append(center)
                radii.append(float(mine_off.max()))
                sets.append(mine)
                if len(mine) > 1:
                    nodes.append(self._new())
                    open_nodes.append((nodes[-1], mine, mine_off))
                else:
                    nodes.append(-1)
                rest, far = rest[~near], far[~near]
                if len(rest):
                    center = rest[0]
            self.children[node], self.radius[node] = np.array(points), np.array(radii)
            self.below[node], self.members[node] = np.array(nodes), sets

    def _new(self) -> int:
        for part in (self.children, self.radius, self.below, self.members):
            part.append(None)
        return len(self.children) - 1


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, ids: np.ndarray, best: Best) -> None:
    """Put into ``best`` whatever beats it, going down both trees together.

    No point below a node is farther from the node's point than its radius, so that an inner product of points
    below two nodes exceeds that of the nodes' points by at most
    ``radius_q * |x| + radius_x * |q| + radius_q * radius_x``. A pair of nodes is left out if that stays below the worst
    k-th score of all queries below its query node.
    """
    if not len(ids) or not len(query_ids):
        return

    def offer(q: np.ndarray, x: np.ndarray, score: np.ndarray) -> None:
        exact = np.rint(score).astype(np.int64)
        exact[query_ids[q][:, None] == ids[x][None, :]] = np.iinfo(np.int64).min
        least = best.worst[q]
        if len(x) > 4 * best.k:
            least = np.maximum(least, np.partition(exact, len(x) - best.k, axis=1)[:, len(x) - best.k])
        row, column = np.nonzero((exact >= least[:, None]) & (exact > np.iinfo(np.int64).min))
        best.add(q[row], exact[row, column], ids[x[column]])

    pairs = [(0, 0)]
    while pairs:
        q_node, x_node = pairs.pop()
        q, x = queries.children[q_node], data.children[x_node]
        score = queries.points[q] @ data.points[x].T
        offer(q, x, score)
        q_radius, x_radius = queries.radius[q_node], data.radius[x_node]
        q_below, x_below = queries.below[q_node], data.below[x_node]
        bound = (score + q_radius[:, None] * data.norm[x][None, :] + queries.norm[q][:, None] * x_radius[None, :]
                 + q_radius[:, None] * x_radius[None, :])
        # Rounding must never leave out a pair.
        bound = bound * (1 + 1e-9 * np.sign(bound)) + 1e-6
        q_members, x_members = queries.members[q_node], data.members[x_node]
        worst = np.array([best.worst[members].min() for members in q_members])
        left = (bound >= worst[:, None]) & ((q_below[:, None] >= 0) | (x_below[None, :] >= 0))
        if not left.any():
            continue
        some_q, some_x = np.flatnonzero(left.any(axis=1)), np.flatnonzero(left.any(axis=0))
        q_sizes = np.array([len(q_members[n]) for n in some_q], dtype=float)
        x_sizes = np.array([len(x_members[n]) for n in some_x], dtype=float)
        needed = q_sizes @ left[np.ix_(some_q, some_x)] @ x_sizes
        if q_sizes.sum() * x_sizes.sum() <= max(DENSE * needed, SMALL):
            # Hardly anything can be left out below: all points at once cost less than going down pair by pair.
            every_x = np.concatenate([x_members[n] for n in some_x])
            every_q = np.concatenate([q_members[n] for n in some_q])
            for at in range(0, len(every_q), 512):
                part = every_q[at:at + 512]
                offer(part, every_x, queries.points[part] @ data.points[every_x].T)
            continue
        rows, columns = np.nonzero(left)
        order = np.argsort(bound[rows, columns])
        for r, c in zip(rows[order], columns[order]):
            one = q_below[r] if q_below[r] >= 0 else _single(queries, int(q[r]))
            other = x_below[c] if x_below[c] >= 0 else _single(data, int(x[c]))
            pairs.append((int(one), int(other)))


def _single(tree: CoverTree, point: int) -> int:
    """A node that holds one point only, to go down the other tree with."""
    singles = tree.__dict__.setdefault("singles", {})
    if point not in singles:
        node = singles[point] = tree._new()
        tree.children[node], tree.radius[node] = np.array([point]), np.zeros(1)
        tree.below[node], tree.members[node] = np.array([-1]), [np.array([point])]
    return singles[point]


def _scaled(components: np.ndarray) -> np.ndarray:
    return np.floor(256 * components).astype("<f8")


def _check_range(one: np.ndarray, other: np.ndarray) -> None:
    top = float(np.abs(one).max(initial=0)) * float(np.abs(other).max(initial=0)) * max(1, one.shape[1])
    if top >= 2.0 ** 53:
        raise OverflowError("components are too large for exact integer scores: products must stay below 2 ** 53")


def exact_top(table: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row chosen by ``queries`` the ``k`` highest inner products.

    ``table(vec_id, embedding)``; each component x counts as ``floor(256 * x)``. Rows with null, or null or non-finite
    components, take no part; ties go to the smaller id; a query's own row is no candidate; shorter
    vectors count as filled up with 0. Products must stay below 2 ** 53, which is checked.

    The top level of the index is a small net of rows from a bounded sample. Every row joins the block of its
    nearest net point; large blocks are cut, so that a hot one is many. Queries meet every block, in blocks of their own,
    and a task builds cover trees over both and goes down them together. What a query must beat at least is
    learnt beforehand from the sample.
    """
    vectors = checkpoint(with_bytes(clean_vectors(table), _scaled))
    rows, asked = vectors.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    sample = some_rows(vectors, SAMPLE).collect()
    sample_ids = np.array([r.vec_id for r in sample], dtype=np.int64)
    sample_points = matrix([bytes(r.raw) for r in sample])
    anchors = _net(sample_points, ANCHORS)
    size = min(BLOCK[1], max(BLOCK[0], -(-rows // 64)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, net = same_width(matrix(batch["raw"].to_pylist()), anchors)
            off = (net * net).sum(axis=1)[None, :] - 2 * points @ net.T
            yield batch.append_column("anchor", pa.array(off.argmin(axis=1).astype(np.int32)))

    assigned = checkpoint(vectors.mapInArrow(placed, "vec_id long, raw binary, anchor int"))
    counts = {r.anchor: r["count"] for r in assigned.groupBy("anchor").count().collect()}
    firsts, blocks = {}, 0
    for anchor in sorted(counts):
        firsts[anchor] = (blocks, -(-counts[anchor] // size))
        blocks += firsts[anchor][1]
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    if not blocks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.create_map(*[F.lit(x) for anchor, (first, _) in firsts.items() for x in (anchor, first)])
    pieces = F.create_map(*[F.lit(x) for anchor, (_, count) in firsts.items() for x in (anchor, count)])
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31))
    data = assigned.select(
        "vec_id", "raw", (place[F.col("anchor")] + (spread % pieces[F.col("anchor")])).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = CoverTree(sample_points)
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            points = matrix(batch["raw"].to_pylist())
            worst = _worst(points, ids, tree, sample_ids, k)
            yield batch.append_column("floor", pa.array(worst))

    asking = (vectors.where(queries).mapInArrow(floors, "vec_id long, raw binary, floor long")
              .select("*", (spread % query_blocks).cast("int").alias("part"),
                      F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))

    def searched(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        best = _search(left, right, k)
        return pd.DataFrame({"query_id": best[0], "vec_id": best[1], "score": best[2]})

    found = (asking.groupBy("block", "part").cogroup(data.groupBy("block", "part"))
             .applyInPandas(searched, "query_id long, vec_id long, score long"))
    return best_rows(found, k)


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query_ids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    asked, points = same_width(matrix(left["raw"]), matrix(right["raw"]))
    _check_range(asked, points)
    best = Best(len(query_ids), k, left["floor"].to_numpy())
    dual_search(CoverTree(asked), query_ids, CoverTree(points), ids, best)
    return query_ids[best.query], best.id, best.score


def _worst(points: np.ndarray, ids: np.ndarray, tree: CoverTree, others: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query among the sample; the lowest number there is if the sample has fewer rows."""
    low = np.full(len(ids), np.iinfo(np.int64).min)
    if not len(others):
        return low
    points, known = same_width(points, tree.points)
    _check_range(points, known)
    best = Best(len(ids), k, low)
    # The trees must be of one width.
    dual_search(CoverTree(points), ids, tree if known is tree.points else CoverTree(known), others, best)
    return best.worst


def _net(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` points, each the farthest from those before it: the top levels of a cover tree."""
    if not len(points):
        return np.zeros((1, 0))
    chosen = [0]
    off = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and off.max() > 0:
        chosen.append(int(off.argmax()))
        off = np.minimum(off, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


ORACLE = """
WITH fine AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS embedding
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x)) AS v FROM fine),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""

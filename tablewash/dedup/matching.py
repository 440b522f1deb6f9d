"""Comparison of candidate pairs and the match decision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Codebook
from ..session import checkpoint
from ..types import InvalidValueError
from .candidates import CELL, Candidates, cells, grouped_cells

# Rows handled together in a task: small cells are joined up to this number.
STEP_ROWS = 2048
# Pairs compared in one step: all combinations of values are counted in long steps, links are
# looked for in short ones, because pairs already linked are not compared any more.
COUNT_PAIRS, LINK_PAIRS = 1_000_000, 65_536
# Texts so long that a full step makes so many short ones are proven apart in full steps.
PROOF_STEPS = 8
# Pairs in a step however long the texts are.
LEAST_PAIRS = 64
# Texts of a column of which all pairs are compared for a large cell, and combined texts that are looked up together.
TABLE_TEXTS, JOINT_TEXTS = 2_048, 4_096
# Rough costs in ns that decide how a whole table is counted: a pair of records; a record met by a group of others; a product.
PAIR_COST, MEETING_COST, PRODUCT_COST = 15, 10, 0.05
# Similarities that a text is taken to have to others of its column, for these costs, and most cells of a product's factor.
USUAL_VALUES, FACTOR_CELLS = (4, 10), 16_000_000
# Whole numbers up to this are exact in four bytes.
EXACT = 2 ** 24
# Neighbours in an order that are compared with each other before a whole table is.
NEAR_ROWS = 1_024
# Combinations of similarities that are counted in a plain table.
COUNT_TABLE = 4_000_000
# Partitions of cells per shuffle partition: few bytes make much work, so they must not be merged.
CELL_SPREAD = 2
# Rounding slack of sums of similarities.
SLACK = 1e-9
# Starting centres of the two groups of pairs, in every dimension.
APART_START, ALIKE_START = 0.05, 0.95


@dataclass(frozen=True)
class Decision:
    """A pair matches when the weighted sum of its similarities exceeds ``bound``."""

    weights: tuple[float, ...]
    bound: float


def threshold_decision(columns: int, threshold: float) -> Decision:
    """Mean similarity of at least ``threshold``."""
    if not 0 < threshold <= 1:
        raise InvalidValueError("the threshold lies between 0 and 1")
    return Decision((1.0 / columns,) * columns, threshold - SLACK)


def similarity_vectors(found: Candidates) -> DataFrame:
    """Distinct similarity vectors ``(s0, s1, ...)`` of the candidate pairs and how many pairs have each.

    Pairs of rows are counted through the copies of their signatures. Tasks count before they
    write, so the result has as many rows as there are different vectors, not pairs.
    """
    names = [f"s{i}" for i in range(len(found.columns))]
    schema = ", ".join(f"{n} double" for n in names) + ", pair_count long"
    texts = found.texts
    if found.index == "full" and (order := _grouped_order(found)):
        return _grouped_vectors(found, order, names, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_cells(batches):
            counts = _counts_by_table(group, texts, names)
            if counts is not None:
                yield counts
                continue
            for part, _ in _parts(group, texts):
                books = _codebooks(part, texts)
                copies = part["copies"].to_numpy()
                for left, right in _pairs(part, COUNT_PAIRS):
                    yield _vector_counts(books, left, right, copies[left] * copies[right], names)

    pairs = _arranged(found).mapInArrow(count, schema)
    alike = F.col("copies") * (F.col("copies") - 1) / 2
    copies = found.signatures.where("copies > 1").select(
        *[c.alias(n) for c, n in zip(_self_similarity(found), names)], alike.cast("long").alias("pair_count"))
    return pairs.unionByName(copies).groupBy(*names).agg(F.sum("pair_count").alias("pair_count"))


def _grouped_order(found: Candidates) -> list[int] | None:
    """The compared columns by their number of texts, if pairs of a whole table are better counted by groups of equal
    records than one by one; None else."""
    counts = [F.count_distinct(F.coalesce(F.col(name), F.lit(""))) for name in found.texts]
    size, *known = found.signatures.agg(F.count(F.lit(1)), *counts).first()
    order = sorted(range(len(known)), key=lambda i: known[i])
    if len(order) < 3 or size <= STEP_ROWS or max(known) >= TABLE_TEXTS:
        return None
    few, some, many = order[:-2], known[order[-2]], known[order[-1]]
    groups = min(size, float(np.prod([known[i] for i in few], dtype=float)))
    kinds = float(np.prod([min(known[i], USUAL_VALUES[0]) for i in few]))
    products = kinds * some * many * min(some, size / groups) * USUAL_VALUES[1]
    by_groups = groups * (size * MEETING_COST + products * PRODUCT_COST)
    return order if by_groups < size * size / 2 * PAIR_COST else None


def _grouped_vectors(found: Candidates, order: list[int], names: list[str], schema: str) -> DataFrame:
    """``similarity_vectors`` of a whole table: each group of records equal in all columns but two meets the whole table.

    So every pair is met from both sides, and every record meets itself.
    """
    texts = found.texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _each_cell(batches):
            yield _counts_by_groups(cell, texts, names, order)

    placed = grouped_cells(found, [texts[i] for i in order[:-2]])
    twice = _arranged(found, placed).mapInArrow(count, schema)
    # Copies of a record: half of copies * copies met, less half of the copies, is their number of pairs.
    selves = found.signatures.select(*[c.alias(n) for c, n in zip(_self_similarity(found), names)],
                                     (-F.col("copies")).alias("pair_count"))
    return (twice.unionByName(selves).groupBy(*names).agg(F.expr("sum(pair_count) div 2").alias("pair_count"))
            .where("pair_count > 0"))


def _counts_by_groups(cell: pa.Table, texts: list[str], names: list[str], order: list[int]) -> pa.RecordBatch:
    """Counted vectors of all records of side 0 with all of side 1.

    For a group of records of side 0 that differ in two columns only, side 1 is counted by its similarities in the
    other columns and its texts in these two; one of the two is then summed up by similarity in a product of matrices.
    """
    books = _codebooks(cell, texts)
    tables = [book.table() for book in books]
    few, some, many = order[:-2], order[-2], order[-1]
    sizes = [len(values) for values, _ in tables]
    strides = [int(np.prod(sizes[i + 1:], dtype=np.int64)) for i in range(len(sizes))]
    side, copies = cell["side"].to_numpy(), cell["copies"].to_numpy().astype(float)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    known = [len(book.lengths) for book in books]
    group = np.ravel_multi_index([books[i].codes for i in few], [known[i] for i in few])
    left = left[np.lexsort((books[some].codes[left], group[left]))]
    met, member = np.unique(group[right], return_inverse=True)
    met = np.unravel_index(met, [known[i] for i in few])
    inner = books[some].codes[right] * known[many] + books[many].codes[right]
    weights = None if (copies[right] == 1).all() else copies[right]
    found: dict[int, float] = {}
    totals = np.zeros(int(np.prod(sizes, dtype=np.int64))) if np.prod(sizes, dtype=float) <= COUNT_TABLE else None
    # Large groups are taken in pieces of so many texts of the column before the last that a product keeps its bound.
    fresh = np.append(True, np.diff(group[left]) != 0)[:len(left)]
    turns = np.cumsum(fresh | np.append(True, np.diff(books[some].codes[left]) != 0)[:len(left)])
    turns -= np.maximum.accumulate(np.where(fresh, turns, 0))
    piece = turns // max(1, FACTOR_CELLS // (known[some] * sizes[many]))
    starts = np.flatnonzero(fresh | (np.append(0, np.diff(piece))[:len(left)] != 0))
    for start, end in zip(starts, [*starts[1:], len(left)]):
        members = left[start:end]
        # Side 1 by kinds: its similarities to the group in the few columns.
        kind = np.zeros(len(met[0]), dtype=np.int64)
        for i, codes in zip(few, met):
            kind += tables[i][1][books[i].codes[members[0]]][codes] * np.int64(strides[i])
        kinds, kind = np.unique(kind, return_inverse=True)
        width = known[some] * known[many]
        # Similarities in the last column of the members with one text in the column before.
        mine, turn = np.unique(books[some].codes[members], return_inverse=True)
        seen, place = np.unique(tables[many][1][books[many].codes[members]], return_inverse=True)
        place = place.reshape(len(members), known[many])
        columns = len(mine) * len(seen)
        at = (np.arange(known[many]) * columns + (turn * len(seen))[:, None]) + place
        sums = np.bincount(at.ravel(), np.repeat(copies[members], known[many]), known[many] * columns)
        sums = sums.reshape(known[many], columns)
        used = np.flatnonzero(sums.any(axis=0))
        sums = sums[:, used]
        # For each text of the column before and each sum: the place of both similarities in a vector.
        last = (tables[some][1][mine[used // len(seen)]].T * np.int64(strides[some])
                + seen[used % len(seen)] * np.int64(strides[many]))
        places, last = np.unique(last, return_inverse=True)
        step = max(1, FACTOR_CELLS // max(width, known[some] * len(used)))
        for first in range(0, len(kinds), step):
            taken = kind - first
            inside = (taken >= 0) & (taken < step)
            rows = slice(None) if inside.all() else np.flatnonzero(inside[member])
            count = min(step, len(kinds) - first)
            counted = np.bincount((taken * width)[member[rows]] + inner[rows], None if weights is None else weights[rows],
                                  count * width).reshape(count * known[some], known[many])
            largest = counted.sum(axis=1).max() * sums.max()
            exact = np.float32 if largest < EXACT else np.float64
            product = counted.astype(exact) @ sums.astype(exact)
            where = np.arange(count)[:, None] * len(places) + last.reshape(1, -1)
            result = np.bincount(where.ravel(), product.reshape(count, -1).ravel(), count * len(places))
            hit = np.flatnonzero(result)
            vectors = kinds[first + hit // len(places)] + places[hit % len(places)]
            if totals is not None:
                totals[vectors] += result[hit]
            else:
                for vector, number in zip(vectors.tolist(), result[hit].tolist()):
                    found[vector] = found.get(vector, 0) + number
    if totals is not None:
        vectors = np.flatnonzero(totals)
        numbers = totals[vectors]
    else:
        vectors, numbers = np.array(list(found), dtype=np.int64), np.array(list(found.values()))
    arrays = [pa.array(values[place]) for (values, _), place in zip(tables, np.unravel_index(vectors, sizes))]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(numbers.astype(np.int64))], names=[*names, "pair_count"])


def two_means(vectors: DataFrame) -> Decision | None:
    """Split the candidate pairs into two groups by similarity; the upper one matches.

    Lloyd's rounds over the counted vectors from fixed starting centres, until the centres stay or, for
    centres that only differ by rounding, come back to where they were. ``None`` stands for
    "every candidate matches", the rule for fewer than two candidate pairs.
    """
    names = [c for c in vectors.columns if c != "pair_count"]
    vectors = checkpoint(vectors)
    if (vectors.agg(F.sum("pair_count")).first()[0] or 0) < 2:
        return None
    low, high = [APART_START] * len(names), [ALIKE_START] * len(names)
    seen = set()
    while True:
        decision = _between(low, high)
        alike = _score(decision, [F.col(n) for n in names]) > decision.bound
        weight = F.col("pair_count")
        sums = [F.sum(F.when(side, weight * value)).alias(f"{label}{i}")
                for label, side in (("low", ~alike), ("high", alike))
                for i, value in enumerate([F.lit(1), *[F.col(n) for n in names]])]
        row = vectors.agg(*sums).first()
        moved = []
        for label, centre in (("low", low), ("high", high)):
            total = row[f"{label}0"]
            moved.append([row[f"{label}{i + 1}"] / total for i in range(len(names))] if total else centre)
        shift = sum((a - b) ** 2 for old, new in zip((low, high), moved) for a, b in zip(old, new))
        low, high = moved
        if shift < SLACK ** 2 or (state := (*low, *high)) in seen:
            break
        seen.add(state)
    return _between(low, high)


def matched_edges(found: Candidates, decision: Decision | None, placed: DataFrame | None = None) -> DataFrame:
    """Links ``(a, b)`` whose connected components are those of all matching pairs, or of those in the cells ``placed``.

    Each cell reduces its matches to one link per signature: from the smallest id of its group.
    A link from an id to itself says that the copies of that signature match each other.
    """
    texts = found.texts

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_cells(batches):
            yield from _links(group, texts, decision)

    links = _arranged(found, placed).mapInArrow(link, "a long, b long")
    return links.unionByName(copies_edges(found, decision))


def copies_edges(found: Candidates, decision: Decision | None) -> DataFrame:
    """A link from each signature to itself whose copies match each other."""
    alike = F.lit(True) if decision is None else _score(decision, _self_similarity(found)) > decision.bound
    return found.signatures.where((F.col("copies") > 1) & alike).select(F.col("sid").alias("a"), F.col("sid").alias("b"))


def near_edges(found: Candidates, decision: Decision) -> DataFrame:
    """Links ``(a, b)`` of matching records that stand close to each other in the order by one column, then the others."""
    texts = found.texts

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, NEAR_ROWS):
                rows = pa.Table.from_batches([batch.slice(start, NEAR_ROWS)])
                cell = {name: pa.array(np.zeros(rows.num_rows, dtype=np.int64)) for name in CELL}
                for name, zeros in cell.items():
                    rows = rows.append_column(name, zeros)
                yield from _links(rows.combine_chunks(), texts, decision)

    links = None
    for turn in range(len(texts)):
        order = [F.col(name) for name in texts[turn:] + texts[:turn]]
        near = (found.signatures.select("sid", *texts).repartitionByRange(*order).sortWithinPartitions(*order)
                .mapInArrow(link, "a long, b long"))
        links = near if links is None else links.unionByName(near)
    return links


def _links(group: pa.Table, texts: list[str], decision: Decision | None) -> Iterator[pa.RecordBatch]:
    """At most one link per signature of some whole cells."""
    label = np.arange(group.num_rows)
    for part, rows in _parts(group, texts):
        books = _codebooks(part, texts)
        step = _steps(books)
        together = step <= LINK_PAIRS // PROOF_STEPS
        for left, right in _pairs(part, step, LINK_PAIRS if together else 0):
            a, b = rows[left], rows[right]
            apart = np.flatnonzero(label[a] != label[b])
            if together:
                # Most pairs are proven apart at once, the others looked at in short steps.
                apart = apart[_matching(books, left[apart], right[apart], decision, proof=True)]
            for some in np.split(apart, range(step, len(apart), step)):
                some = some[label[a[some]] != label[b[some]]]
                keep = some[_matching(books, left[some], right[some], decision)]
                if len(keep):
                    label = _merged(label, a[keep], b[keep])
    linked = np.flatnonzero(label != np.arange(len(label)))
    if len(linked):
        ids = group["sid"].to_numpy()
        a, b = stars(ids[label[linked]], ids[linked])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _between(low: list[float], high: list[float]) -> Decision:
    """Closer to ``high`` than to ``low`` is a linear test."""
    weights = tuple(2 * (h - l) for l, h in zip(low, high))
    return Decision(weights, sum(h * h for h in high) - sum(l * l for l in low))


def _score(decision: Decision, similarities: list[Column]) -> Column:
    total = F.lit(0.0)
    for weight, value in zip(decision.weights, similarities):
        total = total + F.lit(weight) * value
    return total


def _self_similarity(found: Candidates) -> list[Column]:
    """Similarity of a record with its copy: 1, but 0 where there is no text."""
    return [F.when(F.length(t) > 0, 1.0).otherwise(0.0) for t in found.texts]


def _arranged(found: Candidates, placed: DataFrame | None = None) -> DataFrame:
    placed = cells(found) if placed is None else placed
    partitions = CELL_SPREAD * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(partitions, *CELL[:-1]).sortWithinPartitions(*CELL)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of complete cells, as many as fit; the last cell of a batch waits for its continuation."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        starts = _cell_starts(table)
        begin = 0
        for start, end in zip(starts[:-1], starts[1:]):
            if end - begin > STEP_ROWS and start > begin:
                yield table.slice(begin, start - begin).combine_chunks()
                begin = int(start)
        if len(starts) and starts[-1] > begin:
            yield table.slice(begin, starts[-1] - begin).combine_chunks()
            begin = int(starts[-1])
        rest = table.slice(begin)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each cell."""
    waiting, last = [], None
    for batch in batches:
        edges = [*_cell_starts(pa.Table.from_batches([batch])).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            cell = tuple(batch[name][start].as_py() for name in CELL[:-1])
            if waiting and cell != last:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
            waiting.append(batch.slice(start, end - start))
            last = cell
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _cell_starts(table: pa.Table) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    if len(changed):
        changed[0] = True
    for name in CELL[:-1]:
        values = table[name].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _pairs(table: pa.Table, step_pairs: int, most_pairs: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row positions of the pairs of all cells in the table, in steps of bounded size, which grow up to ``most_pairs``."""
    rows = table.num_rows
    starts = _cell_starts(table)
    lengths = np.diff(np.append(starts, rows))
    ends = np.repeat(starts + lengths, lengths)
    side = table["side"].to_numpy()
    right_starts = np.repeat(np.add.reduceat(side == 0, starts) + starts, lengths)
    across = (table["kind"].to_numpy() == 1) | (table["row_tile"].to_numpy() != table["col_tile"].to_numpy())
    position = np.arange(rows)
    first = np.where(across, right_starts, position + 1)
    counts = np.where(across & (side == 1), 0, ends - first)
    upto = np.cumsum(counts)
    row = 0
    while row < rows:
        done = upto[row - 1] if row else 0
        stop = max(int(np.searchsorted(upto, done + step_pairs, side="right")), row + 1)
        step = counts[row:stop]
        left = np.repeat(position[row:stop], step)
        if len(left):
            inner = np.arange(len(left)) - np.repeat(np.cumsum(step) - step, step)
            yield left, np.repeat(first[row:stop], step) + inner
        row = stop
        step_pairs = max(step_pairs, min(2 * step_pairs, most_pairs))


def _codebooks(table: pa.Table, texts: list[str]) -> list[Codebook]:
    books = []
    for name in texts:
        coded = table[name].combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        books.append(Codebook(codes, coded.dictionary.to_pylist(), table.num_rows ** 2 // 2))
    return books


def _parts(group: pa.Table, texts: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """What is compared with one codebook, and where its rows are: all, or pieces of a large cell of many texts."""
    rows = np.arange(group.num_rows)
    if group.num_rows <= 2 * STEP_ROWS or all(_few(group[name]) for name in texts):
        yield group, rows
        return
    side, size = group["side"].to_numpy(), STEP_ROWS // 2
    across = group["kind"][0].as_py() == 1 or group["row_tile"][0].as_py() != group["col_tile"][0].as_py()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (rows, rows)
    for a in range(0, len(left), size):
        for b in range(0 if across else a, len(right), size):
            own = not across and a == b
            taken = left[a:a + size] if own else np.concatenate([left[a:a + size], right[b:b + size]])
            part = group.take(pa.array(taken)).combine_chunks()
            if not across:
                second = np.arange(len(taken)) >= len(left[a:a + size])
                part = part.set_column(part.schema.get_field_index("side"), "side", pa.array(second.astype(np.int32)))
                part = part.set_column(part.schema.get_field_index("kind"), "kind",
                                       pa.array(np.full(len(taken), 0 if own else 1, dtype=np.int32)))
            yield part, taken


def _few(column: pa.ChunkedArray) -> bool:
    return len(column.unique()) < TABLE_TEXTS


def _counts_by_table(group: pa.Table, texts: list[str], names: list[str]) -> pa.RecordBatch | None:
    """Counted vectors of one large cell, by a table of all pairs of texts of each column; None if one is too large."""
    if group.num_rows <= STEP_ROWS or not all(_few(group[name]) for name in texts) or len(_cell_starts(group)) > 1:
        return None
    books = _codebooks(group, texts)
    tables = [book.table() for book in books]
    sizes = [len(values) for values, _ in tables]
    combinations = int(np.prod(sizes, dtype=float))
    if combinations > COUNT_TABLE:
        return None
    strides = [int(np.prod(sizes[i + 1:])) for i in range(len(sizes))]
    # Columns are looked up together as long as their combined texts are few.
    joint: list[list[int]] = []
    for i, book in enumerate(books):
        if joint and np.prod([len(books[k].lengths) for k in joint[-1]]) * len(book.lengths) <= JOINT_TEXTS:
            joint[-1].append(i)
        else:
            joint.append([i])
    codes = [np.ravel_multi_index([books[i].codes for i in some], [len(books[i].lengths) for i in some]) for some in joint]
    side, copies = group["side"].to_numpy(), group["copies"].to_numpy()
    across = side.any()
    order = np.lexsort(codes[::-1])
    left = order[side[order] == 0]
    right = order[side[order] == 1] if across else left
    right_codes = [code[right] for code in codes]
    weighted = len(np.unique(copies)) > 1

    def looked_up(some: list[int], row: int) -> np.ndarray:
        found = np.zeros(1, dtype=np.int64)
        for i in some:
            found = np.add.outer(found, tables[i][1][books[i].codes[row]] * np.int64(strides[i])).ravel()
        return found

    totals = np.zeros(combinations)
    keys = np.empty(max(COUNT_PAIRS, len(right)), dtype=np.int64)
    weights = np.empty(len(keys)) if weighted else None
    used, known, first = 0, -1, None
    for place, row in enumerate(left):
        start = 0 if across else place + 1
        width = len(right) - start
        if used + width > len(keys):
            totals += np.bincount(keys[:used], None if weights is None else weights[:used], combinations)
            used = 0
        if codes[0][row] != known:
            known, first = codes[0][row], looked_up(joint[0], row).take(right_codes[0])
        step = keys[used:used + width]
        step[:] = first[start:]
        for some, code in zip(joint[1:], right_codes[1:]):
            step += looked_up(some, row).take(code[start:])
        if weights is not None:
            np.multiply(copies[right[start:]], copies[row], out=weights[used:used + width], casting="unsafe")
        used += width
    totals += np.bincount(keys[:used], None if weights is None else weights[:used], combinations)
    if not weighted:
        totals *= float(copies[0]) ** 2
    found = np.flatnonzero(totals)
    arrays = [pa.array(values[place]) for (values, _), place in zip(tables, np.unravel_index(found, sizes))]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(totals[found].astype(np.int64))], names=[*names, "pair_count"])


def _vector_counts(books: list[Codebook], left: np.ndarray, right: np.ndarray, weights: np.ndarray,
                   names: list[str]) -> pa.RecordBatch:
    seen = [book.similarities(left, right) for book in books]
    sizes = [len(values) for values, _ in seen]
    if np.prod(sizes, dtype=float) <= COUNT_TABLE:
        totals = np.bincount(np.ravel_multi_index([where for _, where in seen], sizes), weights=weights)
        used = np.flatnonzero(totals)
        places = np.unravel_index(used, sizes)
        totals = totals[used]
    else:
        key = np.zeros(len(left), dtype=np.int64)
        for values, where in seen:
            # Re-numbered after each column so that the combined key cannot overflow.
            _, key = np.unique(key * len(values) + where, return_inverse=True)
        _, sample, group = np.unique(key, return_index=True, return_inverse=True)
        places = [where[sample] for _, where in seen]
        totals = np.bincount(group, weights=weights)
    arrays = [pa.array(values[place]) for (values, _), place in zip(seen, places)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(totals.astype(np.int64))], names=[*names, "pair_count"])


def _matching(books: list[Codebook], left: np.ndarray, right: np.ndarray, decision: Decision | None,
              proof: bool = False) -> np.ndarray:
    """Positions of the matching pairs; short columns first, and pairs that cannot match any more drop out.

    With ``proof`` those pairs drop out that are proven not to match, the longest column being looked at only for that.
    """
    keep = np.arange(len(left))
    if decision is None:
        return keep
    order = sorted(range(len(books)), key=lambda i: books[i].lengths.mean())
    score = np.zeros(len(left))
    still = sum(max(w, 0.0) for w in decision.weights)
    for i in order:
        still -= max(decision.weights[i], 0.0)
        if decision.weights[i] > 0:
            possible = score + decision.weights[i] * books[i].ceiling(left[keep], right[keep]) + still > decision.bound - SLACK
            keep, score = keep[possible], score[possible]
        limits = None
        if i == order[-1] and decision.weights[i] > 0:
            # Nothing follows: only whether the pair matches is asked.
            limits = _limits(books[i].longer(left[keep], right[keep]), score, decision.weights[i], decision.bound)
            if proof:
                return keep[~books[i].beyond(left[keep], right[keep], limits)]
        values, where = books[i].similarities(left[keep], right[keep], limits)
        score = score + decision.weights[i] * values[where]
        possible = score + still > decision.bound - SLACK
        keep, score = keep[possible], score[possible]
        if not len(keep):
            return keep
    return keep[score > decision.bound]


def _limits(longer: np.ndarray, score: np.ndarray, weight: float, bound: float) -> np.ndarray:
    """The largest distance of each pair at which its score exceeds the bound, or 0."""
    most = np.floor((1 - (bound - score) / weight) * longer) + 1
    for _ in range(2):
        most -= score + weight * (1 - most / np.maximum(longer, 1)) <= bound
    return np.maximum(most, 0).astype(np.int64)


def _steps(books: list[Codebook]) -> int:
    """Pairs looked at in one step: few long ones, as each link found spares comparisons in later steps."""
    length = max(book.lengths.mean() for book in books)
    return max(LEAST_PAIRS, int(LINK_PAIRS / max(1.0, length / 8)))


def _merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels after linking pairs of positions: each the smallest position of its group."""
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        for side in (label[left], label[right], left, right):
            np.minimum.at(fresh, side, low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            return label
        label = fresh


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id and other members of each connected group of the given pairs of ids."""
    members, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    label = _merged(np.arange(len(members)), where[:len(left)], where[len(left):])
    other = np.flatnonzero(label != np.arange(len(members)))
    return members[label[other]], members[other]

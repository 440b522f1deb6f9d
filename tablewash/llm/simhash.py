"""Near copies of texts by SimHash, with distances counted on bit planes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dedup.clusters import connected_components
from ..session import checkpoint
from .tokens import in_pieces

BITS = 64
RADIUS = 3
SHINGLE = 3
# The fingerprint is cut into so many blocks; two within the radius agree in all but RADIUS of them.
BLOCKS = 5
# Fingerprints with one key that are compared in one piece; larger sets are dealt into pairs of tiles.
TILE = 4096
# Sorted rows compared at a time.
SLICE = 1 << 17
# Bit planes added between two looks at which words of lanes are still needed.
STEP = 8
# Groups up to this size are compared together, larger ones in blocks of so many rows.
SMALL = 32
QUERIES = 128
FULL = ~np.uint64(0)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in more than half of the hashes of all shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hashed(joined, 42)]
    else:
        ends = np.cumsum([len(word) + 1 for word in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes = [hashed(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    table = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    # Bit k of byte j of a hash is its bit 8 * j + k.
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(table), 1 << 16):
        ones += np.unpackbits(table[at:at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(table)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, mark: Column | None = None) -> DataFrame:
    """``(doc_id, fp)`` with the 64 bits as a signed number; a null text has no words. One pass, no shuffle.

    ``mark``, a text made of the row, is carried along.
    """
    carried = [] if mark is None else ["mark"]

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 4 << 20):
            texts = pc.fill_null(batch["text"].cast(pa.large_binary()), b"").to_pylist()
            found = np.array([fingerprint(text, shingle) for text in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(found.view(np.int64)),
                                              *[batch[name] for name in carried]], names=["doc_id", "fp", *carried])

    read = documents.select("doc_id", "text", *([] if mark is None else [mark.alias("mark")]))
    return read.mapInArrow(computed, "doc_id long, fp long" + (", mark string" if carried else ""))


def _keys(fp, radius: int, blocks: int) -> list:
    """One key for each choice of blocks that two fingerprints within the radius can agree in."""
    edges = [BITS * n // blocks for n in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(edges[n], edges[n + 1])) for n in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[n] for n in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(number).cast("int").alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("key")))
    return keys


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row p holds bit p of all values, 64 values to a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((BITS, -(-len(values) // 64) * 64), dtype=np.uint8)
    padded[:, :len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _moved(plane: np.ndarray, places: int) -> np.ndarray:
    """The planes with lane i holding what lane ``i + places`` held; lanes beyond the end hold 0."""
    words, bits = divmod(places, 64)
    out = np.zeros_like(plane)
    out[:, :plane.shape[1] - words] = plane[:, words:]
    if bits:
        high = np.zeros_like(out)
        high[:, :-1] = out[:, 1:] << np.uint64(64 - bits)
        out = (out >> np.uint64(bits)) | high
    return out


def near_lanes(differing: Callable[[int, np.ndarray], np.ndarray], radius: int, wanted: np.ndarray) -> np.ndarray:
    """For each lane of ``wanted`` (bits in words) whether the two values in it differ in at most ``radius`` bits.

    ``differing(plane, words)`` gives the differing bits of one plane in some words of lanes. The distances of all
    lanes are counted at once: each plane is added to counters that are bit planes themselves (sum and
    carry), and a lane that passes the radius is marked as over. Words all of whose lanes are over are
    left out of the planes that follow.
    """
    width = (radius + 1).bit_length()
    alive = np.flatnonzero(wanted)
    over = ~wanted[alive]
    counters = np.zeros((width, len(alive)), dtype=np.uint64)
    for begin in range(0, BITS, STEP):
        for plane in range(begin, min(BITS, begin + STEP)):
            carry = differing(plane, alive)
            for digit in range(width):
                counters[digit], carry = counters[digit] ^ carry, counters[digit] & carry
            # What reaches radius + 1 is over for good, so that the counters never overflow unseen.
            hit = ~over
            for digit in range(width):
                hit &= counters[digit] if (radius + 1) >> digit & 1 else ~counters[digit]
            over |= hit
        kept = over != FULL
        if not kept.all():
            alive, over, counters = alive[kept], over[kept], counters[:, kept]
        if not len(alive):
            break
    near = np.zeros_like(wanted)
    near[alive] = ~over
    return near


def _lanes(flags: np.ndarray) -> np.ndarray:
    """Flags as bits in words; the last axis is filled up to whole words."""
    padded = np.zeros((*flags.shape[:-1], -(-flags.shape[-1] // 64) * 64), dtype=np.uint8)
    padded[..., :flags.shape[-1]] = flags
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def _set_lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def near_labels(values: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """For each row the smallest row it is connected with by values of one group within the radius; rows are sorted.

    Rows of small groups are compared with the row 1, 2, 3, ... further on, for all groups at once. A
    large group is compared by itself, a block of its rows at a time with all rows after them.
    """
    begins = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(begins, len(groups)))
    label = np.arange(len(values))
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    left, right = _small_groups(values, np.repeat(begins + sizes, sizes), small, radius)
    label = forest(left, right, label)
    for begin, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL]):
        held = planes(values[begin:begin + size])
        width = held.shape[1]
        for first in range(0, size, QUERIES):
            queries = np.arange(first, min(size, first + QUERIES))
            lanes = _lanes(np.arange(size)[None, :] > queries[:, None]).reshape(-1)
            bits = (values[begin + queries][None, :].astype("<u8") >> np.arange(BITS, dtype="<u8")[:, None]) & np.uint64(1)
            masks = np.uint64(0) - bits
            near = near_lanes(lambda plane, at: held[plane, at % width] ^ masks[plane, at // width], radius, lanes)
            at = _set_lanes(near)
            label = forest(begin + first + at // (64 * width), begin + at % (64 * width), label)
    return label


def _small_groups(values: np.ndarray, ends: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    shift, held = 1, planes(values[rows])
    reach = ends[rows] - rows
    while True:
        inside = reach > shift
        if not inside.any():
            return np.concatenate(left), np.concatenate(right)
        wanted = _lanes(inside)
        moved = _moved(held, shift)
        near = near_lanes(lambda plane, at: held[plane, at] ^ moved[plane, at], radius, wanted)
        at = _set_lanes(near)
        left.append(rows[at])
        right.append(rows[at + shift])
        shift += 1


def forest(left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The labels after joining ``left`` and ``right``: for each place the smallest it is connected with."""
    while True:
        one, other = label[left], label[right]
        apart = one != other
        if not apart.any():
            return label
        left, right, one, other = left[apart], right[apart], one[apart], other[apart]
        low = np.minimum(one, other)
        parent = np.arange(len(label))
        np.minimum.at(parent, one, low)
        np.minimum.at(parent, other, low)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]


def _compare(radius: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows >= SLICE:
                # The last group may go on in the next batch.
                whole = _groups(rest)
                cut = int(np.searchsorted(whole, whole[-1]))
                if cut:
                    yield _links(rest.slice(0, cut), whole[:cut], radius)
                    rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield _links(rest, _groups(rest), radius)

    return compared


def _groups(table: pa.Table) -> np.ndarray:
    columns = [table[name].to_numpy() for name in ("choice", "key", "tile", "other")]
    changed = np.zeros(table.num_rows, dtype=bool)
    for column in columns:
        changed[1:] |= column[1:] != column[:-1]
    return np.cumsum(changed)


def _links(table: pa.Table, groups: np.ndarray, radius: int) -> pa.RecordBatch:
    values = table["fp"].to_numpy()
    label = near_labels(values.view(np.uint64), groups, radius)
    linked = np.flatnonzero(label != np.arange(len(values)))
    return pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[label[linked]])], names=["a", "b"])


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``(a, b)``: links that connect all of ``distinct(fp)`` that lie within ``radius`` bits of each other.

    Cut into ``blocks``, two such fingerprints agree in at least ``blocks - radius`` of them, so that all pairs meet
    under a key made of that many blocks. A key with more than ``tile`` fingerprints is dealt into tiles, and
    each pair of tiles is compared by itself. What a task finds leaves it as one link per fingerprint.
    """
    keyed = distinct.select("fp", F.explode(F.array(*_keys(F.col("fp"), radius, blocks))).alias("k")).select("fp", "k.*")
    crowded = (keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > 1)
               .withColumn("tiles", F.ceil(F.col("many") / tile).cast("int")))
    met = keyed.join(crowded, ["choice", "key"])
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                        lambda n: F.struct(F.least(own, n).alias("tile"), F.greatest(own, n).alias("other")))
    dealt = (met.withColumn("pair", F.explode(pairs)).select("choice", "key", "pair.*", "fp")
             .repartition("choice", "key", "tile", "other").sortWithinPartitions("choice", "key", "tile", "other"))
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def _labelled(first: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``(fp, first, label)``: the distinct fingerprints with the label of their component."""
    links = near_links(first.select("fp"), radius, blocks)
    labels = checkpoint(connected_components(links)).withColumnRenamed("id", "fp")
    return (first.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
            .select("fp", "first", "label"))


def near_copies(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``documents``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the smallest ``doc_id``
    that links lead to. Texts without words have fingerprint 0 and are linked like others. Equal
    fingerprints are compared once, so that groups of copies cost one row. A null ``doc_id`` never gives its
    component a name unless all of them are null.
    """
    marked = checkpoint(fingerprints(documents, shingle))
    named = _labelled(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), radius, blocks)
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    component = named.join(lowest, "label").select("fp", "component_id")
    return (marked.join(component, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def drop_near_copies(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                     blocks: int = BLOCKS) -> DataFrame:
    """``documents`` with one row of each component: the least by ``doc_id`` (nulls last), fingerprint and md5 of the text.

    Ids need not be unique: components that share an id, or have none, keep a row each. Of rows equal in id and text the
    least by the other columns stays. Only ids and marks are shuffled to find what stays, texts at most once.
    """
    # The fingerprint follows from the text, so that id and md5 name the rows that may stay.
    mark = lambda number, text: F.concat_ws(
        " ", F.coalesce(number.cast("long").cast("string"), F.lit("-")), F.coalesce(F.md5(text), F.lit("-")))
    marked = checkpoint(fingerprints(documents, shingle, mark(F.col("doc_id"), F.col("text"))))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "mark")
    named = _labelled(marked.groupBy("fp").agg(F.min(place).alias("first")), radius, blocks)
    stay = named.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.mark").alias("mark"))
    # Columns of the documents travel inside one, so that none clashes with those used here.
    plain = [F.col(f"row.`{name}`") for name, kind in documents.dtypes
             if name not in ("doc_id", "text") and not kind.startswith(("map", "array", "struct", "variant"))]
    return (documents.select(F.struct("*").alias("row"))
            .withColumn("mark", mark(F.col("row.doc_id"), F.col("row.text"))).join(stay, "mark")
            .groupBy("mark").agg(F.min_by("row", F.struct(F.lit(0), *plain)).alias("row")).select("row.*"))

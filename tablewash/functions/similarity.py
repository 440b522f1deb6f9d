"""Damerau-Levenshtein similarity of many pairs at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np

# Entries (pairs x length) of one work array; small enough to stay in a processor cache.
BUDGET = 160_000
# Texts up to this length are handled with two-byte distances.
SHORT = 10_000
# Pairs with more signs on the longer side are compared one by one, a whole row of the matrix at a time.
LONG = 200
# What a few pairs of short texts cost one by one, before and per row, and together, per cell.
ROW_FIRST, CELL_COST = 40, 8
# Rows of a bounded comparison after which it looks whether the bound can still be met.
LOOK_ROWS = 128
# Texts of a column of which all pairs' latest comparisons are kept.
KEPT_TEXTS = 256
# Classes of signs that are told apart when many long pairs are looked at together; rarer signs share the last one.
CLASSES = 64
# Bits of a word, words of one work array, and the most pairs that are looked at together.
WORD, WORDS, LANES = 64, 12_288, 1_024
# Looks at the bounds of such pairs, signs between the cells looked at, and how much longer a text may be than another.
LOOKS, GRAIN, SPREAD = 32, 8, 1.25
# Texts up to this length are not worth it. Nor is it to go on with a share of the pairs, or with so few that a row
# costs less one by one: so many less the more signs they have.
BRIEF, REST, FEW_SIGNS = 64, 0.05, 60_000


class Texts:
    """Texts as numbers, one after the other in a single array."""

    def __init__(self, texts: Sequence[str]):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        known, signs = np.unique(signs, return_inverse=True)
        self.signs = signs.astype(np.int16 if len(known) < SHORT else np.int32)
        self.known = len(known)

    @cached_property
    def classes(self) -> np.ndarray:
        """Signs as numbers below ``CLASSES``; no text comes farther from another by it."""
        if self.known <= CLASSES:
            return self.signs.astype(np.uint8)
        common = np.argsort(-np.bincount(self.signs, minlength=self.known), kind="stable")
        place = np.full(self.known, CLASSES - 1, dtype=np.uint8)
        place[common[:CLASSES - 1]] = np.arange(CLASSES - 1)
        return place[self.signs]

    def padded(self, starts: np.ndarray, lengths: np.ndarray, pad: int) -> np.ndarray:
        """Matrix with one column per stretch of signs, filled up with ``pad``."""
        position = np.arange(lengths.max(initial=0))[:, None]
        inside = position < lengths
        rows = np.full(inside.shape, pad, dtype=self.signs.dtype)
        rows[inside] = self.signs[(starts + position)[inside]]
        return rows

    def common(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """How many signs are equal from the given positions on (``step`` 1) or backwards (-1)."""
        count = np.zeros(len(left), dtype=np.int64)
        active = np.flatnonzero(limit > 0)
        done = 0
        while len(active):
            active = active[self.signs[left[active] + done * step] == self.signs[right[active] + done * step]]
            count[active] += 1
            done += 1
            active = active[limit[active] > done]
        return count


def distances(texts: Texts, left: np.ndarray, right: np.ndarray, limits: np.ndarray | None = None) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of pairs of texts given by their positions.

    With ``limits`` the result only tells whether the distance of a pair is within its limit: long pairs may get any
    number on the right side of it.

    What both texts begin and end with does not matter and is cut off. For the rest the linear-space
    recurrence of Zhao and Sahni (2019) is run: cell by cell for a whole batch of short pairs, sorted by length
    so that batches hardly pad, and row by row for each long pair. With limits a batch of few pairs is compared one by one.
    """
    a, b = texts.starts[left], texts.starts[right]
    a_len, b_len = texts.lengths[left], texts.lengths[right]
    head = texts.common(a, b, np.minimum(a_len, b_len), 1)
    tail = texts.common(a + a_len - 1, b + b_len - 1, np.minimum(a_len, b_len) - head, -1)
    a, b, a_len, b_len = a + head, b + head, a_len - head - tail, b_len - head - tail
    longer = np.maximum(a_len, b_len)
    # With nothing left on one side the distance is the length of the other.
    result = longer.copy()
    order = np.flatnonzero(np.minimum(a_len, b_len) > 0)
    for pair in order[longer[order] > LONG]:
        one, other = texts.signs[a[pair]:a[pair] + a_len[pair]], texts.signs[b[pair]:b[pair] + b_len[pair]]
        result[pair] = _long(one, other) if limits is None else _within(one, other, int(limits[pair]))
    order = order[longer[order] <= LONG]
    order = order[np.argsort(longer[order], kind="stable")]
    start = 0
    while start < len(order):
        # Lengths ascend: halve the batch until its padded size fits.
        stop = min(start + BUDGET, len(order))
        while stop > start + 1 and (stop - start) * (longer[order[stop - 1]] + 2) > BUDGET:
            stop = start + (stop - start + 1) // 2
        batch = order[start:stop]
        height, width = int(a_len[batch].max()), int(b_len[batch].max())
        if limits is not None and len(batch) * (ROW_FIRST + height) < CELL_COST * height * width:
            for pair in batch:
                one, other = texts.signs[a[pair]:a[pair] + a_len[pair]], texts.signs[b[pair]:b[pair] + b_len[pair]]
                result[pair] = _within(one, other, int(limits[pair]))
        else:
            result[batch] = _batch(texts, a[batch], a_len[batch], b[batch], b_len[batch])
        start = stop
    return result


def _batch(texts: Texts, a_start: np.ndarray, a_len: np.ndarray, b_start: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    a, b = texts.padded(a_start, a_len, -1), texts.padded(b_start, b_len, -2)
    pairs, height, width = len(a_len), a.shape[0], b.shape[0]
    kind = np.int16 if max(height, width) < SHORT else np.int32
    far = kind(max(height, width) + 1)
    # Row r of these arrays is column r - 1 of the distance matrix.
    now = np.empty((width + 2, pairs), dtype=kind)
    now[0] = far
    now[1:] = np.arange(width + 1, dtype=kind)[:, None]
    above = np.full((width + 2, pairs), far, dtype=kind)
    saved = np.full((width + 2, pairs), far, dtype=kind)
    last_row = np.full((width, pairs), -1, dtype=kind)
    last_col, two_back, crossing, best, other, rows, cols, mask = (np.empty(pairs, dtype=kind) for _ in range(8))
    result = np.zeros(pairs, dtype=np.int64)
    every, one = np.arange(pairs), kind(1)

    def put(target: np.ndarray, value) -> None:
        """Assign where ``mask`` has all bits set; much faster than a masked copy."""
        np.bitwise_xor(target, value, out=other)
        np.bitwise_and(other, mask, out=other)
        np.bitwise_xor(target, other, out=target)

    for i in range(1, height + 1):
        now, above = above, now
        last_col.fill(-1)
        two_back[:] = now[1]
        now[1] = i
        crossing.fill(far)
        for j in range(1, width + 1):
            np.negative(a[i - 1] == b[j - 1], out=mask, dtype=kind, casting="unsafe")
            # Replace or keep; insert or delete.
            np.add(above[j], mask, out=best)
            np.minimum(best, now[j], out=best)
            np.minimum(best, above[j + 1], out=best)
            best += one
            # Swap with the last earlier match in this row or in this column.
            np.subtract(kind(i), last_row[j - 1], out=rows)
            np.subtract(kind(j), last_col, out=cols)
            np.multiply(rows != one, far, out=other, dtype=kind, casting="unsafe")
            other += crossing
            other += cols
            np.minimum(best, other, out=best)
            np.multiply(cols != one, far, out=other, dtype=kind, casting="unsafe")
            other += saved[j + 1]
            other += rows
            np.minimum(best, other, out=best)
            put(last_col, kind(j))
            put(saved[j + 1], above[j - 1])
            put(crossing, two_back)
            two_back[:] = now[j + 1]
            now[j + 1] = best
        found = np.negative(b == a[i - 1], dtype=kind, casting="unsafe")
        last_row ^= (last_row ^ kind(i)) & found
        done = a_len == i
        if done.any():
            result[done] = now[b_len[done] + 1, every[done]]
    return result


def _within(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """A number that is within the limit just if the distance is.

    A swap with other signs in between costs two or more, and one more at most if it is done by replacing. So the
    restricted distance, which has swaps of neighbours only, is no less than the distance and no more than 1.5 times it.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    restricted = _restricted(a, b, limit + limit // 2)
    if restricted <= limit:
        return restricted
    return limit + 1 if 2 * restricted > 3 * limit else _long(a, b)


def _restricted(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Distance with swaps of neighbours only (Hyyrö 2003), or any number above the limit if it is larger.

    A row of the matrix is held as the bits of two numbers: where it rises and where it falls by one.
    """
    if len(a) > len(b):
        a, b = b, a
    width, height = len(b), len(a)
    if width - height > limit:
        return limit + 1
    every = (1 << width) - 1
    places = {sign: int.from_bytes(np.packbits(b == sign, bitorder="little").tobytes(), "little")
              for sign in np.unique(b).tolist()}
    left = height - width + np.arange(width + 1)
    rise, fall, same, before = every, 0, 0, 0
    for i, sign in enumerate(a.tolist(), 1):
        found = places.get(sign, 0)
        same = (((((found & rise) + rise) ^ rise) | found | fall) & every
                | ((found & (every ^ same)) << 1) & before)
        up = (fall | (every ^ (same | rise))) << 1 | 1
        rise = (((same & rise) << 1) | (every ^ ((same | up) & every))) & every
        fall = up & same
        before = found
        if i % LOOK_ROWS == 0:
            row = np.zeros(width + 1, dtype=np.int32)
            np.cumsum(_bits(rise, width) - _bits(fall, width), out=row[1:])
            # What is left of the texts after this row and each column differs in length by so much.
            if i + (row + np.abs(left - i)).min() > limit:
                return limit + 1
    return height + rise.bit_count() - fall.bit_count()


def beyond(texts: Texts, left: np.ndarray, right: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Which pairs of texts are proven to be farther apart than their limits; of others nothing is known.

    Many pairs are followed at once through a matrix of distances that are no larger than the true ones but for some swaps, as
    long as the limit can still be kept. A swap may have signs in between in both texts, which costs no less than replacing all; in
    the longer one only, which is allowed for by taking a sign as equal to the one it was to be swapped with; or in the
    shorter one only, which costs one less than without swaps. Each of the latter costs two at least and takes a
    sign away that has to be put back, so a distance within the limit has at most (limit - difference in length) / 3 of them.
    """
    swap = texts.lengths[left] > texts.lengths[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    off, length = texts.lengths[right] - texts.lengths[left], texts.lengths[right]
    result = off > limits
    order = np.flatnonzero(~result & (length > BRIEF))
    order = order[np.lexsort((left[order], right[order], length[order]))]
    # What is left of each batch is tried once more, together.
    for rest in (REST, 0):
        start = 0
        while start < len(order):
            signs = int(length[order[start]])
            # A band is about as wide as the limit.
            lanes = min(max(WORDS // (int(limits[order[start]]) // WORD + 2), 1), LANES)
            alike = int(np.searchsorted(length[order], SPREAD * signs, side="right"))
            batch = order[start:min(start + lanes, alike)]
            few = max(FEW_SIGNS // (signs + FEW_SIGNS // 30), int(rest * len(batch)))
            if len(batch) > few:
                result[batch] = _beyond(texts, left[batch], right[batch], limits[batch], few)
            start += len(batch)
        order = order[~result[order]]
    return result


def _beyond(texts: Texts, left: np.ndarray, right: np.ndarray, limits: np.ndarray, few: int) -> np.ndarray:
    """As ``beyond``, for pairs of longer and shorter texts, until no more than ``few`` are left."""
    result = np.zeros(len(left), dtype=bool)
    lane = np.arange(len(left))
    starts, heights, off = texts.starts[left], texts.lengths[left], texts.lengths[right] - texts.lengths[left]
    used, place = np.unique(right, return_inverse=True)
    table, place = _places(texts, used), place * CLASSES
    words = len(table)
    caps = limits + (limits - off) // 3
    # An alignment within the limit has no shift s between the texts with abs(s) + abs(s - off) above it, and one sign beyond
    # with the swaps taken apart.
    low, high = int(((off - limits - 1) // 2).min()) - 2, int(((off + limits + 2) // 2).max()) + 2
    # Bits of each word of the longer texts: where a row of the matrix rises and falls, where the last cell of a diagonal
    # rose, and the places of the sign of this row and of the one before.
    shape = (words, len(lane))
    rise, unlike = (np.full(shape, np.uint64(2 ** WORD - 1)) for _ in range(2))
    fall, places, before = (np.zeros(shape, dtype=np.uint64) for _ in range(3))
    work = np.empty((3, words * len(lane)), dtype=np.uint64)
    # Distance of the cell before the first word.
    base = np.zeros(len(lane), dtype=np.int32)
    first = last = 0
    step = max(GRAIN, int(texts.lengths[right].max()) // LOOKS)
    ends = np.zeros(int(heights.max()) + 1, dtype=bool)
    ends[heights] = True
    for i in range(1, len(ends)):
        last = max(last, min((i + high) // WORD + 1, words))
        while first < last - 1 and WORD * (first + 1) <= i + low:
            base += np.bitwise_count(rise[first]).astype(np.int32) - np.bitwise_count(fall[first])
            first += 1
        shape = (last - first, len(lane))
        same, up, spare = work[:, :shape[0] * shape[1]].reshape(3, *shape)
        places, before = before, places
        found, rising, falling, other = places[first:last], rise[first:last], fall[first:last], unlike[first:last]
        np.take(table[first:last], place + texts.classes[starts + (i - 1)], axis=1, out=found, mode="clip")
        _shift(other, spare, 0)
        np.bitwise_and(other, before[first:last], out=other)
        np.bitwise_or(other, found, out=other)
        np.bitwise_or(other, falling, out=other)
        np.bitwise_and(found, rising, out=up)
        np.add(up, rising, out=same)
        _carry(same, up)
        np.bitwise_xor(same, rising, out=same)
        np.bitwise_or(same, other, out=same)
        np.bitwise_or(same, rising, out=up)
        np.bitwise_not(up, out=up)
        np.bitwise_or(up, falling, out=up)
        np.bitwise_and(rising, same, out=other)
        _shift(up, spare, 1)
        _shift(other, spare, 0)
        np.bitwise_or(same, up, out=rising)
        np.bitwise_not(rising, out=rising)
        np.bitwise_or(rising, other, out=rising)
        np.bitwise_and(up, same, out=falling)
        np.bitwise_not(same, out=other)
        base += 1
        if i % step and not ends[i]:
            continue
        cells, shifts = _row(rising, falling, base, off, WORD * first - i)
        ended = heights <= i
        far = cells.min(axis=0) > caps
        result[lane[far]] = True
        alive = ~(far | ended)
        count = int(alive.sum())
        if count <= few:
            break
        # How far a way through these cells can still leave them.
        free = (caps - cells).max(axis=1)
        open_ = free >= 0
        free = free[open_] // 2 + GRAIN
        low = max(low, int((np.minimum(shifts[open_], off.min()) - free).min()) - 2)
        high = min(high, int((np.maximum(shifts[open_], off.max()) + free).max()) + 2)
        if count <= 0.8 * len(lane) or ended.any():
            lane, starts, heights, place, base, off, caps = (
                values[alive] for values in (lane, starts, heights, place, base, off, caps))
            rise, fall, unlike, places, before = (
                np.compress(alive, bits, axis=1) for bits in (rise, fall, unlike, places, before))
    return result


def _carry(sums: np.ndarray, parts: np.ndarray) -> None:
    """Add to each word of sums what the words below carry over, that is where a sum is less than a part of it."""
    carries, full = sums < parts, sums == np.uint64(2 ** WORD - 1)
    step = 1
    while step < len(sums) and full.any():
        carries[step:] |= full[step:] & carries[:-step]
        full[step:] &= full[:-step].copy()
        full[:step] = False
        step *= 2
    np.add(sums[1:], carries[:-1], out=sums[1:], casting="unsafe")


def _shift(bits: np.ndarray, spare: np.ndarray, entering: int) -> None:
    """One place up, over all words."""
    np.right_shift(bits[:-1], np.uint64(WORD - 1), out=spare[1:])
    spare[0] = entering
    np.left_shift(bits, np.uint64(1), out=bits)
    np.bitwise_or(bits, spare, out=bits)


def _row(rise: np.ndarray, fall: np.ndarray, base: np.ndarray, off: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """What cells of a row, ``GRAIN`` signs apart, and those around them allow at least as the whole distance; their shifts.

    From a cell to its neighbour that bound changes by two at most.
    """
    words, lanes = rise.shape
    change = np.bitwise_count(rise.view(np.uint8)).view(np.int8) - np.bitwise_count(fall.view(np.uint8)).view(np.int8)
    cells = np.empty((words * WORD // GRAIN + 1, lanes), dtype=np.int32)
    cells[0] = base
    cells[1:].reshape(words, WORD // GRAIN, lanes)[:] = change.reshape(words, lanes, WORD // GRAIN).transpose(0, 2, 1)
    for place in range(1, len(cells)):
        cells[place] += cells[place - 1]
    shifts = shift + GRAIN * np.arange(len(cells), dtype=np.int32)
    # From any cell the rest costs the difference in length of what is left.
    cells += np.abs(shifts[:, None] - off.astype(np.int32))
    cells -= GRAIN
    return cells, shifts


def _places(texts: Texts, used: np.ndarray) -> np.ndarray:
    """Bits of the places of each class of signs in the given texts: words x (texts x classes)."""
    lengths = texts.lengths[used]
    words = -(-int(lengths.max()) // WORD)
    rows = np.full((len(used), words * WORD), CLASSES, dtype=np.uint8)
    position = np.arange(words * WORD)
    inside = position < lengths[:, None]
    rows[inside] = texts.classes[(texts.starts[used][:, None] + position)[inside]]
    table = np.empty((words, len(used), CLASSES), dtype=np.uint64)
    for sign in range(CLASSES):
        table[:, :, sign] = np.packbits(rows == sign, axis=1, bitorder="little").view(np.uint64).T
    return table.reshape(words, -1)


def _bits(number: int, width: int) -> np.ndarray:
    packed = np.frombuffer(number.to_bytes((width + 7) // 8, "little"), dtype=np.uint8)
    return np.unpackbits(packed, count=width, bitorder="little").astype(np.int32)


def _long(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two texts with array operations along the longer one.

    Within a row only insertion looks at the cell before; as it costs one per step, a running minimum of the
    other costs less their place settles it. All else comes from the rows before.
    """
    if len(a) > len(b):
        a, b = b, a
    width = len(b)
    far = np.int32(len(a) + width + 1)
    place = np.arange(width + 1, dtype=np.int32)
    above, two_above = place.copy(), np.full(width + 1, far)
    # For each column: the last row with its sign, and the cell before the one it crosses in the row above that.
    last_row, saved = np.full(width, -1, dtype=np.int32), np.full(width, far)
    signs, codes = np.unique(a, return_inverse=True)
    where = [np.flatnonzero(b == sign) for sign in signs]
    two_left = np.full(width, far)
    for i, code in enumerate(codes, 1):
        found = where[code]
        best = np.minimum(above[:-1], above[1:])
        best += 1
        best[found] = np.minimum(above[found], best[found])
        if len(found):
            # Swap with the last match in this row, if either is next to the other.
            matched = np.zeros(width, dtype=np.int32)
            matched[found] = found + 1
            last_col = np.empty(width, dtype=np.int32)
            last_col[0] = 0
            np.maximum.accumulate(matched[:-1], out=last_col[1:])
            beside = found[:-1] + 1 if found[-1] == width - 1 else found + 1
            beside = beside[(matched[beside] == 0) & (last_row[beside] > 0)]
            best[beside] = np.minimum(best[beside], saved[beside] + i - last_row[beside])
            under = np.flatnonzero((last_row == i - 1) & (matched == 0) & (last_col > 0))
            best[under] = np.minimum(best[under], two_above[last_col[under] - 1] + place[under + 1] - last_col[under])
        now = np.empty(width + 1, dtype=np.int32)
        now[0] = i
        np.subtract(best, place[1:], out=now[1:])
        np.minimum.accumulate(now, out=now)
        now += place
        two_left[1:] = above[:-2]
        saved[found] = two_left[found]
        last_row[found] = i
        two_above, above = above, now
    return int(above[-1])


def damerau_levenshtein(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Distance of each pair of texts."""
    position = np.arange(len(left))
    return distances(Texts([*left, *right]), position, position + len(left))


def similarity(texts: Texts, left: np.ndarray, right: np.ndarray, limits: np.ndarray | None = None) -> np.ndarray:
    """1 - distance / longer length of pairs of texts that are not both empty; with ``limits`` as ``distances`` says."""
    return 1 - distances(texts, left, right, limits) / np.maximum(texts.lengths[left], texts.lengths[right])


class Codebook:
    """Texts of one column of some rows, coded; similarities are computed once per pair of texts."""

    def __init__(self, codes: np.ndarray, texts: list[str], pairs: int = 0):
        # An empty text behind the last one stands for NULL.
        self.texts = Texts([*texts, ""])
        self.lengths = self.texts.lengths
        self.codes = np.where(codes < 0, len(texts), codes)
        self.values = np.array([0.0, 1.0])
        self.places: np.ndarray | None = None
        self.kept: np.ndarray | None = None
        self.apart: np.ndarray | None = None
        # Pairs of rows that will be asked for in all.
        self.pairs = pairs

    def similarities(self, left: np.ndarray, right: np.ndarray,
                     limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Some similarities, and for each pair of rows the position of its own among them.

        With ``limits``, the distances up to which they matter, others need not be exact.
        """
        a, b = self.codes[left], self.codes[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        size = len(self.lengths)
        if limits is not None and self.lengths.max() > LONG:
            return self._within(low * size + high, limits)
        if self.places is None and size * size > 4 * max(len(low), self.pairs):
            # Few pairs: not worth a table of all pairs of texts.
            key, where = np.unique(low * size + high, return_inverse=True)
            return self._compare(key // size, key % size), where
        if self.places is None:
            self.places = np.full((size, size), -1, dtype=np.int32)
        unknown = self.places[low, high] < 0
        if unknown.any():
            asked = np.zeros((size, size), dtype=bool)
            asked[low[unknown], high[unknown]] = True
            fresh_low, fresh_high = np.nonzero(asked)
            found, where = np.unique(self._compare(fresh_low, fresh_high), return_inverse=True)
            self.places[fresh_low, fresh_high] = len(self.values) + where
            self.values = np.concatenate([self.values, found])
        return self.values, self.places[low, high]

    def beyond(self, left: np.ndarray, right: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Which pairs of rows are proven to have texts farther apart than the limits; each pair of texts is tried once."""
        a, b = self.codes[left], self.codes[right]
        size = len(self.lengths)
        if len(self.codes) < size:
            result = a != b
            result[result] = beyond(self.texts, a[result], b[result], limits[result])
            return result
        key, where = np.unique(np.stack([np.minimum(a, b) * size + np.maximum(a, b), limits]), axis=1, return_inverse=True)
        key, limits = key
        proven = key // size != key % size
        if size <= KEPT_TEXTS:
            if self.apart is None:
                # Up to which limit texts are known to be farther apart, and from which one it was not to be proven.
                self.apart, self.unproven = np.full(size * size, -1), np.full(size * size, np.iinfo(np.int64).max)
            fresh = proven & (self.apart[key] < limits) & (self.unproven[key] > limits)
            proven &= self.apart[key] >= limits
        else:
            fresh, proven = proven, np.zeros(len(key), dtype=bool)
        proven[fresh] = beyond(self.texts, key[fresh] // size, key[fresh] % size, limits[fresh])
        if size <= KEPT_TEXTS:
            np.maximum.at(self.apart, key[proven], limits[proven])
            np.minimum.at(self.unproven, key[fresh & ~proven], limits[fresh & ~proven])
        return proven[where.reshape(-1)]

    def _within(self, pairs: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``similarities``; for few texts it is kept what was found with which limit."""
        size = len(self.lengths)
        key, limit = np.unique(np.stack([pairs, limits]), axis=1, return_inverse=True)
        (key, limits), where = key, limit.reshape(-1)
        if size > KEPT_TEXTS:
            return self._compare(key // size, key % size, limits), where
        if self.kept is None:
            self.kept, self.kept_limits = np.zeros(size * size), np.full(size * size, -1)
        fresh = self.kept_limits[key] != limits
        values = self.kept[key]
        values[fresh] = self._compare(key[fresh] // size, key[fresh] % size, limits[fresh])
        self.kept[key], self.kept_limits[key] = values, limits
        return values, where

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Some similarities, and the position of each pair of texts among them."""
        size = len(self.lengths)
        low, high = np.triu_indices(size)
        values, where = np.unique(self._compare(low, high), return_inverse=True)
        places = np.empty((size, size), dtype=np.int32)
        places[low, high] = places[high, low] = where
        return values, places

    def longer(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the longer text of each pair."""
        return np.maximum(self.lengths[self.codes[left]], self.lengths[self.codes[right]])

    def ceiling(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What the lengths alone allow: a distance is no smaller than the difference in length."""
        a, b = self.lengths[self.codes[left]], self.lengths[self.codes[right]]
        return np.where((a > 0) & (b > 0), np.minimum(a, b) / np.maximum(np.maximum(a, b), 1), 0.0)

    def _compare(self, low: np.ndarray, high: np.ndarray, limits: np.ndarray | None = None) -> np.ndarray:
        filled = (self.lengths[low] > 0) & (self.lengths[high] > 0)
        values = np.where(filled & (low == high), 1.0, 0.0)
        apart = np.flatnonzero(filled & (low != high))
        if len(apart):
            values[apart] = similarity(self.texts, low[apart], high[apart], None if limits is None else limits[apart])
        return values

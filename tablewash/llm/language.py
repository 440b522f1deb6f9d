"""Language of texts by comparing the order of their most frequent letter groups with that of known languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .tokens import in_pieces

# Groups of one to three letters that a profile holds.
PROFILE = 400
UNKNOWN = "und"
# The gap before and after a word.
GAP = "_"


@dataclass
class _Letters:
    """Texts as numbers: letters in lower case count from 1 in code point order, all else is one gap, 0."""

    row: np.ndarray
    sign: np.ndarray
    letters: np.ndarray  # code points
    rows: int
    bits: int = field(init=False)

    def __post_init__(self):
        self.bits = max(1, len(self.letters).bit_length())

    @classmethod
    def of(cls, texts: list[str]) -> _Letters:
        joined = "\n".join(texts)
        points = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "replace"), dtype="<u4")
        sizes = np.array([len(text) + 1 for text in texts], dtype=np.int64)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        row = np.concatenate([row[:1], row])
        top = int(points.max()) + 1
        present = np.flatnonzero(np.bincount(points, minlength=top))
        lower = [low if len(low := chr(p).lower()) == 1 else chr(p) for p in present]
        known = [ord(c) if c.isalpha() else 0 for c in lower]
        letters = np.array(sorted(set(known) - {0}), dtype=np.int64)
        table = np.zeros(top, dtype=np.int32)
        table[present] = np.where(np.array(known) > 0, np.searchsorted(letters, known) + 1, 0)
        sign = table[points]
        kept = np.ones(len(sign), dtype=bool)
        kept[1:] = (sign[1:] > 0) | (sign[:-1] > 0)
        return cls(row[kept], sign[kept], letters, len(texts))

    def counts(self, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(group, gram, count)`` of all letter groups, ``group`` holding a number for each text.

        Each letter is the middle of one group of three, gaps included, and those counts give the shorter ones.
        A gram is a number: its length minus one, then its signs, so that numbers sort like (length, text).
        """
        b = np.uint64(self.bits)
        at = np.flatnonzero(self.sign)
        three = self.sign.astype(np.uint64)
        key = (three[at - 1] << (b + b)) | (three[at] << b) | three[at + 1]
        key |= group[self.row[at]].astype(np.uint64) << np.uint64(3 * self.bits)
        key, count = _runs(key)
        owner, gram = key >> np.uint64(3 * self.bits), key & np.uint64((1 << 3 * self.bits) - 1)
        first, middle, last = gram >> (b + b), (gram >> b) & np.uint64((1 << self.bits) - 1), gram & np.uint64((1 << self.bits) - 1)
        length = np.uint64(3 * self.bits)
        ends = last == 0
        one = middle
        two = (np.uint64(1) << length) | (first << b) | middle
        final = (np.uint64(1) << length) | (middle[ends] << b)
        whole = (np.uint64(2) << length) | gram
        width = np.uint64(3 * self.bits + 2)
        key = np.concatenate([(owner << width) | one, (owner << width) | two, (owner[ends] << width) | final,
                              (owner << width) | whole])
        order = np.argsort(key, kind="stable")
        count = np.concatenate([count, count, count[ends], count])[order]
        key = key[order]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(count, begins) if len(begins) else count[:0]
        key = key[begins]
        return (key >> width).astype(np.int64), key & np.uint64((1 << 3 * self.bits + 2) - 1), total

    def fits(self) -> bool:
        """Whether a text's number, a length and three signs fit into one word."""
        return 3 * self.bits + 2 + self.rows.bit_length() <= 64

    def name(self, gram: int) -> str:
        length, mask = int(gram) >> 3 * self.bits, (1 << self.bits) - 1
        signs = [int(gram) >> self.bits * at & mask for at in range(length, -1, -1)]
        return "".join(chr(self.letters[s - 1]) if s else GAP for s in signs)

    def number(self, name: str) -> int:
        """The gram of a name, or -1 if it has a letter that does not occur here."""
        points = [0 if c == GAP else ord(c) for c in name]
        gram = len(name) - 1
        gram <<= 3 * self.bits
        for at, point in enumerate(points):
            place = int(np.searchsorted(self.letters, point)) if point else -1
            if point and (place == len(self.letters) or self.letters[place] != point):
                return -1
            gram |= (place + 1) << self.bits * (len(name) - 1 - at)
        return gram


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, np.zeros(0, dtype=np.int64)
    key = np.sort(key)
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[begins], np.diff(np.append(begins, len(key)))


def _pieces(texts: list[str], more: list) -> Iterator[tuple[_Letters, list]]:
    letters = _Letters.of(texts)
    if letters.fits() or len(texts) == 1:
        yield letters, more
    else:
        half = len(texts) // 2
        yield from _pieces(texts[:half], more[:half])
        yield from _pieces(texts[half:], more[half:])


@dataclass
class LanguageModel:
    """For each language its most frequent letter groups, most frequent first."""

    profiles: dict[str, list[str]]
    size: int = PROFILE

    def __post_init__(self):
        self.languages = sorted(self.profiles)
        self.grams = sorted({gram for grams in self.profiles.values() for gram in grams})
        place = {gram: n for n, gram in enumerate(self.grams)}
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, dtype=np.int64)
        for n, language in enumerate(self.languages):
            for rank, gram in enumerate(self.profiles[language]):
                self.ranks[n, place[gram]] = rank

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text and how near it is, from 0 to 1."""
        names, scores = [], []
        for letters, part in _pieces(texts, texts):
            name, score = self._predict(letters, len(part))
            names += name
            scores.append(score)
        return names, np.concatenate(scores) if scores else np.zeros(0)

    def _predict(self, letters: _Letters, rows: int) -> tuple[list[str], np.ndarray]:
        row, gram, count = letters.counts(np.arange(rows), rows)
        if not len(row) or not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        order = np.lexsort((gram, -count, row))
        row, gram = row[order], gram[order]
        begins = np.searchsorted(row, np.arange(rows))
        rank = np.arange(len(row)) - begins[row]
        kept = rank < self.size
        row, gram, rank = row[kept], gram[kept], rank[kept]
        numbers = np.array([letters.number(name) for name in self.grams], dtype=np.int64)
        sorted_at = np.argsort(numbers, kind="stable")
        place = np.minimum(np.searchsorted(numbers[sorted_at], gram.astype(np.int64)), len(numbers) - 1)
        place = np.where(numbers[sorted_at[place]] == gram.astype(np.int64), sorted_at[place], len(numbers))
        held = np.bincount(row, minlength=rows)
        distance = np.empty((len(self.languages), rows))
        for n in range(len(self.languages)):
            known = self.ranks[n, place]
            off = np.where(known >= 0, np.abs(known - rank), self.size)
            distance[n] = np.bincount(row, off, minlength=rows)
        best = distance.argmin(axis=0)
        score = 1 - distance[best, np.arange(rows)] / np.maximum(1, held * self.size)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, held)], np.where(held > 0, score, 0.0)


def fit_languages(documents: DataFrame, size: int = PROFILE) -> LanguageModel:
    """Profiles from all rows of ``documents(text, lang)`` whose ``lang`` is known.

    Letter groups are counted in tasks, summed by language and group, and cut to the ``size`` most frequent before
    they meet; ties go to the shorter group, then by code point. What reaches the driver is ``size`` groups for
    each language.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 4 << 20):
            known = batch["lang"].to_pylist()
            for letters, langs in _pieces([text or "" for text in batch["text"].to_pylist()], known):
                names = sorted(set(langs))
                number = {name: n for n, name in enumerate(names)}
                group, gram, count = letters.counts(np.array([number[name] for name in langs]), len(names))
                distinct, place = np.unique(gram, return_inverse=True)
                spelled = pa.array([letters.name(g) for g in distinct], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()).take(pa.array(group)), spelled.take(pa.array(place)),
                     pa.array(count, pa.int64())], names=["lang", "gram", "count"])

    counts = (documents.select("text", "lang").where("lang is not null and text is not null")
              .mapInArrow(counted, "lang string, gram string, count long")
              .groupBy("lang", "gram").agg(F.sum("count").alias("count")))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), F.length("gram"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[tuple[int, str]]] = {}
    for row in best.select("lang", "gram", "rank").collect():
        profiles.setdefault(row.lang, []).append((row.rank, row.gram))
    return LanguageModel({lang: [gram for _, gram in sorted(grams)] for lang, grams in profiles.items()}, size)


def predict_languages(documents: DataFrame, model: LanguageModel, column: str = "lang_pred",
                      score: str = "score") -> DataFrame:
    """``documents`` with the language of the whole ``text`` and its nearness; ``und`` and 0 without any letter.

    One pass, no shuffle; a clashing column is replaced. Equal distances go to the first language by code point.
    """
    plain = documents.drop(column, score)
    schema = StructType([*plain.schema.fields, StructField(column, StringType()), StructField(score, DoubleType())])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 4 << 20):
            names, scores = model.predict(pc.fill_null(batch["text"], "").to_pylist())
            yield (batch.append_column(column, pa.array(names, pa.string()))
                   .append_column(score, pa.array(scores, pa.float64())))

    return plain.mapInArrow(predicted, schema)

"""Toxicity of texts by a classifier that must not react to which group a text mentions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .tokens import in_pieces, row_of, split_words

# Labelled texts a model is fitted on, about; a fixed bound, whatever the size of the corpus.
FIT_ROWS = 12_000
# Features a model holds at most.
FEATURES = 6_000
# Log-likelihood ratio of a stem and the label from which the stem is taken for more than chance.
GAIN = 5.0
# A feature is "the stem occurs at least so often".
LEVELS = (1, 2, 4)
# Stems are whole words and their beginnings of these lengths.
PREFIXES = (4, 5, 6)

# Mentions of groups, each list holding terms that can replace each other.
IDENTITY = [
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs mormons".split(),
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh mormon".split(),
    "black white asian african latino hispanic arab european american native indigenous".split(),
    "mexican chinese indian turkish polish russian french german spanish italian japanese korean".split(),
    "gay lesbian bisexual transgender straight queer trans".split(),
    "immigrants refugees foreigners migrants natives citizens".split(),
    "blind deaf disabled autistic elderly young old".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden hindus atheisten katholiken".split(),
    "ausländer einwanderer flüchtlinge deutsche türken polen".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs athées catholiques".split(),
    "immigrés réfugiés étrangers français arabes africains".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos ateos católicos".split(),
    "inmigrantes refugiados extranjeros españoles mexicanos gitanos".split(),
]
GROUP_OF = {term: group for group in IDENTITY for term in group}

_LETTERS = re.compile(r"[^\W\d_]+")


def _stems(token: str) -> list[str]:
    stems = []
    for word in _LETTERS.findall(token.lower()):
        stems.append(word)
        if word not in GROUP_OF:
            stems += [f"{word[:k]}*" for k in PREFIXES if len(word) > k]
    return stems


def _swapped(token: str, step: int) -> str:
    """The token with each mention of a group replaced by the one ``step`` places on in its list."""

    def other(match: re.Match) -> str:
        group = GROUP_OF.get(match[0])
        return group[(group.index(match[0]) + step) % len(group)] if group else match[0]

    return _LETTERS.sub(other, token.lower())


def _counts(texts: pa.Array, numbers: dict[str, int] | None, step: int = 0) -> tuple[np.ndarray, ...]:
    """``(text, stem, times)`` for each stem of each text; stems not in ``numbers``, if given, are left out.

    Without ``numbers`` stems are numbered as they appear, and their list comes last. With ``step``
    mentions are swapped, and only texts that have some are counted.
    """
    starts, codes, words = split_words(texts)
    own: dict[str, int] = {}
    find = numbers.get if numbers is not None else lambda stem: own.setdefault(stem, len(own))
    lists, touched = [], np.zeros(len(words), dtype=bool)
    for at, token in enumerate(words.to_pylist()):
        token = token.decode("utf-8", "replace")
        if step:
            other = _swapped(token, step)
            touched[at] = other != token.lower()
            token = other
        found = [find(stem) for stem in _stems(token)]
        lists.append([n for n in found if n is not None])
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    stems = np.array([n for x in lists for n in x], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    row = row_of(starts)
    if step:
        touched_rows = np.zeros(len(starts) - 1, dtype=bool)
        touched_rows[row[touched[codes]]] = True
        kept = touched_rows[row]
        row, codes = row[kept], codes[kept]
    many = sizes[codes]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    stem = stems[np.repeat(begins[codes], many) + inside] if many.sum() else np.zeros(0, dtype=np.int64)
    width = max(1, len(own) if numbers is None else len(numbers))
    key, times = np.unique(np.repeat(row, many) * width + stem, return_counts=True)
    return key // width, key % width, times, list(own)


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_pieces(batches, "text", 2 << 20):
        row, stem, times, names = _counts(batch["text"], None)
        toxic = batch["toxic"].to_numpy(zero_copy_only=False)[row].astype(bool)
        sums = np.array([np.bincount(stem[(times >= level) & (toxic == side)], minlength=len(names))
                         for level in LEVELS for side in (True, False)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(list(sums.T.astype(np.int64)), pa.list_(pa.int64()))],
            names=["stem", "counts"])


@dataclass
class ToxicityModel:
    """Weights of stems at each level and a constant; ``score`` is the logistic function of their sum."""

    stems: list[str]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.numbers = {stem: n for n, stem in enumerate(self.stems)}

    def score(self, texts: pa.Array) -> np.ndarray:
        row, stem, times, _ = _counts(texts, self.numbers)
        total = np.full(len(texts), self.bias)
        for at, level in enumerate(LEVELS):
            held = times >= level
            total += np.bincount(row[held], self.weights[stem[held], at], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit_toxicity(labelled: DataFrame, features: int = FEATURES, fairness: float = 4.0) -> ToxicityModel:
    """Learn from ``labelled(text, toxic)``, a bounded number of rows with ``toxic`` 0 or 1.

    Stems are chosen by how well their presence tells the two labels apart (log-likelihood ratio, at least ``GAIN``,
    so that few rows teach few words), all mentions of groups that occur are kept besides. The weights minimise the logistic loss plus a
    ridge plus ``fairness`` times the squared change of the score between a text and its
    counterfactuals, the same text with mentions of groups swapped. Without rows of both labels the score is
    the share of toxic rows, or 0 if there are no rows.
    """
    labelled = checkpoint(labelled.select("text", F.col("toxic").cast("int").alias("toxic")))
    rows, toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < rows:
        return ToxicityModel([], np.zeros((0, len(LEVELS))), 60.0 if toxic else -60.0)
    counts = labelled.mapInArrow(_stem_counts, "stem string, counts array<long>")
    places = range(2 * len(LEVELS))
    sums = counts.groupBy("stem").agg(*[F.sum(F.col("counts")[i]).cast("double").alias(f"n{i}") for i in places])
    sums = sums.where((F.col("n0") + F.col("n1") >= 3) | F.col("stem").isin(list(GROUP_OF)))
    gain = F.greatest(*[_ratio(F.col(f"n{2 * i}"), F.col(f"n{2 * i + 1}"), toxic, rows - toxic)
                        for i in range(len(LEVELS))])
    best = sums.select("stem", gain.alias("gain")).where(F.col("gain") >= GAIN).orderBy(F.desc("gain"), "stem").limit(features)
    stems = [r.stem for r in best.collect()]
    stems += [r.stem for r in sums.where(F.col("stem").isin(list(GROUP_OF))).select("stem").collect()
              if r.stem not in set(stems)]
    numbers = {stem: n for n, stem in enumerate(stems)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 4 << 20):
            label = batch["toxic"].to_numpy(zero_copy_only=False)
            for step in (0, 1, 3):
                row, stem, times, _ = _counts(batch["text"], numbers, step)
                place = np.concatenate([stem[times >= level] * len(LEVELS) + at for at, level in enumerate(LEVELS)])
                row = np.concatenate([row[times >= level] for level in LEVELS])
                order = np.argsort(row, kind="stable")
                some = np.arange(batch.num_rows) if step == 0 else np.unique(row)
                ends = np.searchsorted(row[order], some, side="right")
                begins = np.searchsorted(row[order], some)
                sets = [place[order[a:b]].astype(np.int32) for a, b in zip(begins, ends)]
                if step:  # what changes against the text itself is worked out by the driver from both
                    same = _own_sets(batch["text"], numbers, some)
                else:
                    same = [np.zeros(0, dtype=np.int32)] * len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([step] * len(some), pa.int32()), pa.array(label[some], pa.int32()),
                     pa.array(sets, pa.list_(pa.int32())), pa.array(same, pa.list_(pa.int32()))],
                    names=["step", "toxic", "places", "original"])

    table = labelled.mapInArrow(vectors, "step int, toxic int, places array<int>, original array<int>").toArrow()
    weights, bias = _minimise(table, len(stems) * len(LEVELS), fairness)
    return ToxicityModel(stems, weights.reshape(-1, len(LEVELS)), bias)


def _own_sets(texts: pa.Array, numbers: dict[str, int], some: np.ndarray) -> list[np.ndarray]:
    row, stem, times, _ = _counts(texts.take(pa.array(some)), numbers)
    sets = []
    for n in range(len(some)):
        mine = row == n
        sets.append(np.concatenate([stem[mine & (times >= level)] * len(LEVELS) + at
                                    for at, level in enumerate(LEVELS)]).astype(np.int32))
    return sets


def _ratio(with_toxic, with_clean, toxic: int, clean: int):
    """Log-likelihood ratio of a feature and the label, from its counts among toxic and clean rows."""
    total = toxic + clean
    held = with_toxic + with_clean
    parts = [(with_toxic, held * toxic / total), (with_clean, held * clean / total),
             (toxic - with_toxic, (total - held) * toxic / total),
             (clean - with_clean, (total - held) * clean / total)]
    return sum((F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in parts),
               F.lit(0.0))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, value)`` of all entries of a column of lists."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(whole.offsets.to_numpy())
    return np.repeat(np.arange(len(whole)), sizes), whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _minimise(table: pa.Table, width: int, fairness: float, ridge: float = 2e-4, rounds: int = 400):
    """Weights by Adam on the whole (bounded) table: loss, ridge and counterfactual penalty."""
    step = table["step"].to_numpy()
    texts, pairs = table.filter(pa.array(step == 0)), table.filter(pa.array(step > 0))
    label = texts["toxic"].to_numpy().astype(float)
    row, place = _flat(texts["places"])
    new_row, new = _flat(pairs["places"])
    old_row, old = _flat(pairs["original"])
    n, m = len(label), max(1, pairs.num_rows)
    weights, bias = np.zeros(width), np.log(label.mean() / (1 - label.mean()))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights[place], minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) / n
        gradient = np.bincount(place, error[row], minlength=width) + ridge * weights
        if pairs.num_rows:
            change = (np.bincount(new_row, weights[new], minlength=m) - np.bincount(old_row, weights[old], minlength=m))
            change *= 2 * fairness / m
            gradient += (np.bincount(new, change[new_row], minlength=width)
                         - np.bincount(old, change[old_row], minlength=width))
        gradient = np.append(gradient, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        move = 0.05 * first / (1 - 0.9 ** t) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def labelled_sample(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About ``fit_rows`` texts with their label, chosen by the hash of ``doc_id``; all if there are fewer.

    Several labels of one document count as their majority. Documents not chosen are dropped before the join.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    known = one.count()
    chosen = F.lit(True)
    if known > fit_rows:
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / known)
    return (documents.select("doc_id", "text").where(chosen)
            .join(one.where(chosen).select("doc_id", "toxic"), "doc_id").select("text", "toxic"))


def score_toxicity(documents: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``documents`` with the score of their whole ``text``, from 0 to 1; a null or empty text scores like no words.

    One pass without a shuffle; the model is bounded by the number of features.
    """
    schema = documents.drop(column).schema.add(column, "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", 4 << 20):
            yield batch.append_column(column, pa.array(model.score(batch["text"]), pa.float64()))

    return documents.drop(column).mapInArrow(scored, schema)

"""Probability of texts under a bigram model with Katz backoff.

The work is dealt twice. Documents are read in *pieces* of some megabytes, whose words and bigrams are
counted in one task; what is known about a word or a bigram of the whole corpus is gathered in *shards*, by word or by
first word. A piece sends its distinct words to their shards, which answer with counts over the corpus; then
its distinct bigrams, with the documents they occur in, to theirs, where counts, discounts and backoff
weights meet and each document's share of the sum is worked out. Only compressed arrays travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .tokens import in_pieces, row_of, split_words

# Level of compression of what travels: 6 saves 6 % over 1 for little time.
LEVEL = 6
# Bytes of text of a piece and, about, of a shard; and the fewest shards.
PIECE = 8 << 20
SHARD = 12 << 20
SHARDS = 32
# Counts up to this one are discounted by Good-Turing estimates.
GOOD_TURING = 5
# What larger counts give up, so that each context keeps something for words not seen after it.
HELD_BACK = 0.5
# A context that occurs more often than the first is cut into parts; the second bounds how many contexts that are.
HOT = 50_000
MOST_HOT = 20_000
# Sums of logarithms travel as whole multiples of this part of one, which is less to send than all their bits.
FINE = float(1 << 32)
# Numbers of tokens that are no words.
END, BEGIN, UNKNOWN = -1, -2, -3


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole or real numbers as compressed bytes, bytes of equal weight side by side."""
    head = np.array([len(arrays), *[len(a) for a in arrays]], dtype="<i8").tobytes()
    kinds = "".join("f" if a.dtype.kind == "f" else "i" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a.astype("<f8" if a.dtype.kind == "f" else "<i8")).view(np.uint8)
                    .reshape(-1, 8).T.tobytes() for a in arrays)
    raw = head + kinds + body
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", count, 8)
    at = 8 * (count + 1)
    kinds = raw[at:at + count].decode()
    at += count
    arrays = []
    for kind, size in zip(kinds, sizes):
        planes = np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size)
        arrays.append(np.ascontiguousarray(planes.T).view("<f8" if kind == "f" else "<i8").reshape(-1))
        at += 8 * int(size)
    return arrays


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """What is left of a count of 0 to ``GOOD_TURING`` after Katz's discount, as a factor.

    Where the numbers of rare events are too few or too uneven for Good-Turing, a constant part of a count
    is taken off instead, estimated from the events seen once and twice.
    """
    n = [counts_of_counts.get(r, 0) for r in range(GOOD_TURING + 2)]
    factors = np.ones(GOOD_TURING + 1)
    if all(n[1:]):
        over = (GOOD_TURING + 1) * n[GOOD_TURING + 1] / n[1]
        if over < 1:
            for r in range(1, GOOD_TURING + 1):
                factors[r] = ((r + 1) * n[r + 1] / (r * n[r]) - over) / (1 - over)
    if not (factors[1:] < 1).all() or not (factors[1:] > 0).all():
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        factors = np.array([1.0, *[(r - off) / r for r in range(1, GOOD_TURING + 1)]])
    return factors


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Discounted counts: Good-Turing for small ones; larger ones give up ``HELD_BACK``."""
    return np.where(counts <= GOOD_TURING, counts * factors[np.minimum(counts, GOOD_TURING)], counts - HELD_BACK)


@dataclass
class Unigrams:
    """Probabilities of words from their counts; all unknown words share what discounting leaves."""

    tokens: int
    words: int
    counts_of_counts: dict[int, int]
    mass: float  # sum of all discounted counts

    @classmethod
    def of(cls, tokens: int, words: int, counts_of_counts: dict[int, int]) -> Unigrams:
        factors = discounts(counts_of_counts)
        small = sum(n * r * factors[r] for r, n in counts_of_counts.items() if r <= GOOD_TURING)
        few = sum(n for r, n in counts_of_counts.items() if r <= GOOD_TURING)
        large = tokens - sum(n * r for r, n in counts_of_counts.items() if r <= GOOD_TURING)
        return cls(tokens, words, counts_of_counts, small + large - HELD_BACK * (words - few))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of a word with the given count; a count of 0 stands for all unknown words together."""
        if not self.tokens:
            return np.ones(len(counts))
        seen = discounted(counts, discounts(self.counts_of_counts)) / self.tokens
        return np.where(counts > 0, seen, 1 - self.mass / self.tokens)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.words + 1))


@dataclass
class _Piece:
    """Documents of a piece: words as numbers in the order of their hashes."""

    starts: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray  # unsigned, sorted, distinct

    @classmethod
    def of(cls, texts: pa.Array) -> _Piece:
        starts, codes, words = split_words(texts)
        hashed = np.array([xxhash.xxh64_intdigest(word) for word in words.to_pylist()], dtype=np.uint64)
        distinct, place = np.unique(hashed, return_inverse=True)
        return cls(starts, place[codes] if len(codes) else codes.astype(np.int64), distinct)

    def check(self) -> np.ndarray:
        """A sum of the distinct words, by which two reads of a piece are compared."""
        return np.array([xxhash.xxh64_intdigest(self.hashes.tobytes()) >> 1], dtype=np.int64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(in_pieces(batches, "text", PIECE)):
        yield (part << 24) | number, batch


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"blob": pa.binary(), "kind": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([row[n] for row in rows], kinds.get(name, pa.int64()))
                                       for n, name in enumerate(names)], names=names)


class Katz:
    """A bigram model of the rows of ``documents(doc_id, text, held_out)`` that are not held out, and scores of all rows.

    Tokens are words, lower-cased by A-Z, and one end for each text; a null text has the end only. Every row is scored,
    also rows that repeat or have a null id; without training rows all words are unknown and score 0. Counts are
    gathered from all training rows. The documents are read twice and must be dealt alike both times, as files and
    checkpoints are; this is checked. ``words`` and ``bigrams`` hold the model's tables, dealt by shard, in
    the checkpoint folder: counts of words, of bigrams, and backoff weights.
    """

    def __init__(self, documents: DataFrame):
        self.documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
        size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.shards = max(SHARDS, -(-size // SHARD))
        self.words = checkpoint(self._count_words())
        stats = [_unpack(bytes(r.blob)) for r in self.words.where("kind = 'stats'").select("blob").collect()]
        texts = sum(int(s[0][0]) for s in stats)
        rare = {r: sum(int(s[1][r]) for s in stats) for r in range(1, GOOD_TURING + 2)}
        # The end is a word like others, with the number of training texts as its count.
        if 0 < texts <= GOOD_TURING + 1:
            rare[texts] += 1
        self.texts = texts
        self.unigrams = Unigrams.of(sum(int(s[0][1]) for s in stats) + texts,
                                    sum(int(s[0][2]) for s in stats) + (texts > 0), rare)
        self.hot = max(HOT, -(-self.unigrams.tokens // MOST_HOT))

    def _count_words(self) -> DataFrame:
        """Rows for each shard: answers to the pieces, the shard's table of words, and its statistics."""
        shards = self.shards

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, batch in _numbered(batches):
                found = _Piece.of(batch["text"])
                trained = ~batch["held_out"].to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(found.codes[trained[row_of(found.starts)]], minlength=len(found.hashes))
                edges = np.searchsorted(_shard(found.hashes, shards), np.arange(shards + 1))
                texts = int(trained.sum())
                rows = [(shard, piece, texts if not shard else 0,
                         _pack(np.diff(found.hashes[a:b], prepend=np.uint64(0)).view(np.int64), counts[a:b], found.check()))
                        for shard, (a, b) in enumerate(zip(edges, edges[1:])) if b > a or not shard]
                yield _rows(rows, ["shard", "piece", "texts", "blob"])

        def gathered(frame: pd.DataFrame) -> pd.DataFrame:
            shard = int(frame["shard"].iloc[0])
            parts = [_unpack(blob) for blob in frame["blob"]]
            hashes = np.concatenate([np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in parts])
            distinct, place = np.unique(hashes, return_inverse=True)
            counts = np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(distinct)).astype(np.int64)
            # Words of one count are numbered from 0, so that frequent words have small numbers; number and
            # count together tell words apart.
            order = np.argsort(counts, kind="stable")
            edges = np.searchsorted(counts[order], counts[order])
            numbers = np.empty(len(distinct), dtype=np.int64)
            numbers[order] = (np.arange(len(distinct)) - edges) * shards + shard
            ends = np.cumsum([len(p[0]) for p in parts])
            out = [("answer", int(piece), _pack(numbers[place[b - len(p[0]):b]], counts[place[b - len(p[0]):b]], p[2]))
                   for piece, p, b in zip(frame["piece"], parts, ends)]
            known = counts > 0
            out.append(("table", -1, _pack(np.diff(distinct[known], prepend=np.uint64(0)).view(np.int64), numbers[known], counts[known])))
            sums = np.array([frame["texts"].sum(), counts.sum(), known.sum()])
            rare = np.bincount(np.minimum(counts, GOOD_TURING + 2), minlength=GOOD_TURING + 3)
            out.append(("stats", -1, _pack(sums, rare)))
            return pd.DataFrame([(shard, *row) for row in out], columns=["shard", "kind", "piece", "blob"])

        return (self.documents.mapInArrow(sent, "shard long, piece long, texts long, blob binary")
                .groupBy("shard").applyInPandas(gathered, "shard long, kind string, piece long, blob binary"))

    def scores(self) -> DataFrame:
        """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of the documents.

        A bigram seen in training has its discounted count over its context's count; one not seen backs off to
        its second word's probability times the context's backoff weight, which makes the probabilities of all words and
        of the unknown word add up to one; after an unknown word only the word itself counts.
        """
        self.bigrams = checkpoint(self._count_bigrams())
        stats = [_unpack(bytes(r.blob))[0] for r in self.bigrams.where("kind = 'stats'").select("blob").collect()]
        factors = discounts(dict(enumerate(np.sum(stats, axis=0).tolist())) if stats else {})
        contexts, weights = self._hot_weights(factors)
        tokens = self.unigrams.tokens
        logs = np.log10(factors)

        def summed(frame: pd.DataFrame) -> pd.DataFrame:
            known = frame["kind"] == "doc"
            ids, empty, held, count, seen, base, start = _unpack(frame["blob"][known].iloc[0])
            score = start.astype(float)
            for blob in frame["blob"][~known]:
                row, part, rare_row, rare, times, late_row, late, late_times, own, *sums = _unpack(blob)
                score += np.bincount(row, part / FINE, minlength=len(score))
                score += np.bincount(rare_row, times * logs[rare], minlength=len(score))
                if len(late):
                    weight = np.log10(_left(sums, factors))
                    if len(contexts):
                        place = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
                        weight = np.where(contexts[place] == own, weights[place], weight)
                    score += np.bincount(late_row, late_times * weight[late], minlength=len(score))
            rows = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "held_out": held > 0, "n_tokens": count,
                                 "n_known": seen, "train_tokens": tokens, "base_score": base, "score": score})
            rows["doc_id"] = rows["doc_id"].mask(empty > 0)
            return rows

        return (self.bigrams.where("kind in ('doc', 'sums')").select("piece", "kind", "blob")
                .groupBy("piece").applyInPandas(
                    summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                            "base_score double, score double"))

    def _hot_weights(self, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the backoff weights of contexts that were cut, a bounded number, from the sums of their parts."""
        parts = [_unpack(bytes(r.blob)) for r in self.bigrams.where("kind = 'hot'").select("blob").collect()]
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        contexts, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([p[n] for p in parts])) for n in range(1, len(parts[0]))]
        # Every part carries the context's whole count.
        sums[-1] = sums[-1] / np.bincount(place)
        return contexts, np.log10(_left(sums, factors))

    def _pieces(self) -> DataFrame:
        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece, batch in _numbered(batches):
                found = _Piece.of(batch["text"])
                ids = batch["doc_id"]
                blob = _pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                             batch["held_out"].to_numpy(zero_copy_only=False), np.diff(found.starts), found.codes,
                             found.check())
                yield _rows([(piece, blob)], ["piece", "blob"])

        return self.documents.mapInArrow(coded, "piece long, blob binary")

    def _count_bigrams(self) -> DataFrame:
        shards, unigrams, hot, texts = self.shards, self.unigrams, self.hot, self.texts

        def sent(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            piece = int(left["piece"].iloc[0])
            answers = [_unpack(blob) for blob in right.sort_values("shard")["blob"]]
            rows = _piece_bigrams(piece, _unpack(left["blob"].iloc[0]), answers, shards, unigrams, hot, texts)
            return pd.DataFrame(rows, columns=["shard", "kind", "piece", "blob"])

        def gathered(frame: pd.DataFrame) -> pd.DataFrame:
            rows = _shard_bigrams(frame, unigrams, hot)
            return pd.DataFrame(rows, columns=["kind", "piece", "blob"])

        answers = self.words.where("kind = 'answer'").select("piece", "shard", "blob")
        return (self._pieces().groupBy("piece").cogroup(answers.groupBy("piece"))
                .applyInPandas(sent, "shard long, kind string, piece long, blob binary")
                .groupBy("shard").applyInPandas(gathered, "kind string, piece long, blob binary"))


def _left(sums: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """Backoff weights from, for each context: bigrams seen 1, 2, ... times, the mass of the others, of their words, its count."""
    *rare, large, words, count = sums
    given = sum(r * factors[r] * n for r, n in enumerate(rare, 1)) + large
    return (1 - given / count) / (1 - words)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers scattered over 32 bits."""
    return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def _name(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One number for a word's number and count; the few bits of both are spread over 63."""
    mixed = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + counts.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _runs(key: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys, and the end."""
    return np.append(np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1])), len(key))


def _piece_bigrams(piece: int, state: list[np.ndarray], answers: list, shards: int, unigrams: Unigrams, hot: int,
                   texts: int) -> list[tuple]:
    ids, empty, held, lengths, codes, check = state
    none = np.zeros(0, dtype=np.int64)
    numbers = np.concatenate([none, *[a[0] for a in answers]])
    counts = np.concatenate([none, *[a[1] for a in answers]])
    if any(a[2] != check for a in answers) or codes.max(initial=-1) >= len(numbers):
        raise RuntimeError("the documents were not dealt alike in two reads; read them from files or a checkpoint")
    words = len(numbers)
    docs = len(ids)
    # Codes after those of words: the end, the beginning, unknown words.
    end, begin, unknown = words, words + 1, words + 2
    numbers = np.append(numbers, [END, BEGIN, UNKNOWN])
    counts = np.append(counts, [texts, texts, 0])
    codes = np.where(counts[codes] > 0, codes, unknown) if len(codes) else codes
    ends = np.cumsum(lengths + 1) - 1
    follower = np.full(len(codes) + docs, end)
    is_word = np.ones(len(follower), dtype=bool)
    is_word[ends] = False
    follower[is_word] = codes
    context = np.append(begin, follower[:-1])
    context[ends[:-1] + 1] = begin
    row = np.repeat(np.arange(docs), lengths + 1)
    seen = np.bincount(row, counts[follower] > 0, minlength=docs).astype(np.int64)
    base = np.bincount(row, unigrams.base(counts)[follower], minlength=docs)
    alone = counts[context] == 0
    with np.errstate(divide="ignore"):
        log_word = np.log10(unigrams.probability(counts))
    score = np.bincount(row[alone], log_word[follower[alone]], minlength=docs).astype(float)
    del is_word, codes
    out = [(piece % shards, "doc", piece, _pack(ids, empty, held, lengths + 1, seen, base, score))]
    width = words + 3
    key = (context[~alone] * width + follower[~alone]) * docs + row[~alone]
    del context, follower, row, alone
    key.sort()
    edges = _runs(key)
    key, times = key[edges[:-1]], np.diff(edges)
    doc, key = key % docs, key // docs
    edges = _runs(key)
    key, many = key[edges[:-1]], np.diff(edges)
    trained = np.add.reduceat(times * (held[doc] == 0), edges[:-1]) if len(key) else none
    context, follower = key // width, key % width
    parts = np.where(counts[context] > hot, -(-counts[context] // hot), 1).astype(np.uint64)
    names = _name(numbers, counts)
    shard = ((_mixed(names[context]) + _mixed(names[follower]) % parts) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    fields = [numbers[context], numbers[follower], counts[context], counts[follower], trained, many]
    fields = [field[order] for field in fields]
    places = np.repeat(edges[:-1][order] - (np.cumsum(fields[5]) - fields[5]), fields[5]) + np.arange(len(doc))
    doc, times = doc[places], times[places]
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    before = np.append(0, np.cumsum(fields[5]))
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            inner = slice(before[a], before[b])
            out.append((number, "grams", piece, _pack(*[f[a:b] for f in fields], doc[inner], times[inner])))
    return out


def _shard_bigrams(frame: pd.DataFrame, unigrams: Unigrams, hot: int) -> list[tuple]:
    out = [("doc", int(piece), blob) for piece, blob in zip(frame["piece"][frame["kind"] == "doc"],
                                                           frame["blob"][frame["kind"] == "doc"])]
    grams = frame[frame["kind"] == "grams"]
    if not len(grams):
        return out
    parts = [_unpack(blob) for blob in grams["blob"]]
    context, follower, times_context, times_word, trained = (np.concatenate([p[n] for p in parts]) for n in range(5))
    # Of what came, only the lists of documents are needed again.
    sizes = [len(p[0]) for p in parts]
    parts = [[a.astype(np.int32) for a in p[5:8]] for p in parts]
    spelled = context, follower
    context, follower = _name(context, times_context), _name(follower, times_word)
    order = np.lexsort((follower, context))
    edges = np.flatnonzero(np.append(True, (context[order][1:] != context[order][:-1])
                                     | (follower[order][1:] != follower[order][:-1])))
    first = order[edges]
    count = np.add.reduceat(trained[order], edges)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(order))))
    names, owner = np.unique(context[first], return_inverse=True)
    whole = np.zeros(len(names), dtype=np.int64)
    whole[owner] = times_context[first]
    words = unigrams.probability(times_word[first])
    known = count > 0
    sums = [np.bincount(owner[count == r], minlength=len(names)).astype(float) for r in range(1, GOOD_TURING + 1)]
    sums.append(np.bincount(owner, np.where(count > GOOD_TURING, count - HELD_BACK, 0), minlength=len(names)))
    sums.append(np.bincount(owner[known], words[known], minlength=len(names)))
    sums.append(whole.astype(float))
    cut = whole > hot
    out.append(("hot", -1, _pack(names[cut], *[s[cut] for s in sums])))
    out.append(("stats", -1, _pack(np.bincount(np.minimum(count, GOOD_TURING + 2), minlength=GOOD_TURING + 3))))
    # The table of bigrams: contexts and how many followers each has, then followers and their counts.
    lead = np.searchsorted(owner, np.arange(len(names)))
    out.append(("table", -1, _pack(spelled[0][first][lead], whole, np.bincount(owner[known], minlength=len(names)),
                                   spelled[1][first][known], times_word[first][known], count[known])))
    value = np.where(known, np.log10(np.where(count > GOOD_TURING, count - HELD_BACK, np.maximum(count, 1))
                                     / times_context[first]), np.log10(words))
    del context, follower, times_context, times_word, trained, order, spelled
    at = 0
    for piece, size, (many, doc, times) in zip(grams["piece"], sizes, parts):
        mine = group[at:at + size]
        at += size
        gram = np.repeat(mine, many)
        total = np.bincount(doc, times * value[gram])
        some = np.unique(doc)
        rare = (count[gram] > 0) & (count[gram] <= GOOD_TURING)
        pair, place = np.unique(doc[rare] * 8 + count[gram[rare]], return_inverse=True)
        late = count[gram] == 0
        used, late_place = np.unique(owner[gram[late]], return_inverse=True)
        out.append(("sums", int(piece), _pack(
            some, np.rint(total[some] * FINE).astype(np.int64), pair // 8, pair % 8, np.bincount(place, times[rare], minlength=len(pair)).astype(np.int64),
            doc[late], late_place, times[late], names[used], *[s[used] for s in sums])))
    return out


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; shards hold ranges, so that sorted hashes are sorted by shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)

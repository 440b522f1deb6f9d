"""Exact token counts at every prefix of a text, for BPE models of ``sentencepiece``."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import in_pieces

# The sign that stands for a blank inside pieces.
BLANK = "▁"
# Words that a task remembers, and the longest of them.
REMEMBERED = 1_000_000
WORD = 32
# Characters of a text that are split into words at a time.
BLOCK = 1 << 20
# Characters a normalising model would change, in places where it would trim blanks.
_PROBE = " ﬁ①Ａ  é­​\tİ ½\n ſ "


class PrefixCounter:
    """Counts the tokens of every prefix of a text by one pass from left to right.

    Byte-pair merging has a property that makes this possible: a sequence of pieces is the result of merging their
    text exactly if each piece and its neighbour are the result of merging the two alone. So the last piece of a
    prefix is the one piece that ends there and goes together with the last piece of the prefix before it, and

        tokens[i] = tokens[i - len(piece)] + 1.

    Merging never joins a blank to what stands before it, so words are counted apart, and characters outside the
    vocabulary stay alone and cost as many tokens as they have bytes.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        numbers = range(processor.get_piece_size())
        if processor.normalize(_PROBE) != BLANK + _PROBE.replace(" ", BLANK):
            raise ValueError("prefixes can be counted only for models that leave characters and blanks as they are")
        if not any(processor.is_byte(n) for n in numbers) or any(processor.is_unused(n) for n in numbers):
            raise ValueError("prefixes can be counted only for models with byte fallback and no unused pieces")
        self.scores = {processor.id_to_piece(n): processor.get_score(n) for n in numbers
                       if not (processor.is_byte(n) or processor.is_control(n) or processor.is_unknown(n))}
        # Lengths that a last piece can have, by the last three signs, short ones first: these are the likely ones.
        sizes: dict[str, set[int]] = {}
        for piece in self.scores:
            if len(piece) > 2:
                sizes.setdefault(piece[-3:], {1, 2}).add(len(piece))
        self.sizes = {ending: tuple(sorted(found)) for ending, found in sizes.items()}
        if any(BLANK in piece.lstrip(BLANK) for piece in self.scores):
            raise ValueError("prefixes can be counted only for models whose pieces don't reach over blanks")
        self.words = re.compile(self._word_pattern())
        self.pairs: dict[tuple[str, str], bool] = {}
        self.steps_of: dict[str, bytes] = {}

    def _word_pattern(self) -> str:
        """What can be counted apart: no piece reaches over two signs that stand side by side in none.

        A word ends before a blank, before a sign of punctuation that follows a letter in no piece, and at line breaks.
        """
        beside = {piece[n:n + 2] for piece in self.scores for n in range(len(piece) - 1)}
        known = set("".join(self.scores))
        alone = "".join(c for c in "\n\t\r" if c not in known)
        after = "".join(c for c in '.,;:!?()"' if not any(pair[1] == c and pair[0].isalnum() for pair in beside))
        inside = f"[^{BLANK}{alone}{re.escape(after)}]+" + (f"|(?<![^\\W_])[{re.escape(after)}]" if after else "")
        return (f"{BLANK}+(?:{inside})*|(?:{inside})+" + (f"|[{re.escape(after)}](?:{inside})*" if after else "")
                + (f"|[{alone}]+" if alone else ""))

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair, the first of equals, as long as there is one."""
        parts = list(text)
        while True:
            best, place = None, -1
            for n in range(len(parts) - 1):
                score = self.scores.get(parts[n] + parts[n + 1])
                if score is not None and (best is None or score > best):
                    best, place = score, n
            if best is None:
                return parts
            parts[place:place + 2] = [parts[place] + parts[place + 1]]

    def _together(self, one: str, other: str) -> bool:
        found = self.pairs.get((one, other))
        if found is None:
            found = self.merged(one + other) == ([one, other] if one else [other])
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            self.pairs[one, other] = found
        return found

    def _read_on(self, word: str, lasts: list[str], tokens: list[int]) -> None:
        """Bring ``lasts`` and ``tokens``, for some prefixes of ``word`` from the empty one on, to its end."""
        scores, sizes, pairs = self.scores, self.sizes, self.pairs
        for end in range(len(lasts), len(word) + 1):
            for size in sizes.get(word[end - 3:end], (1, 2)) if end > 2 else (1, 2):
                if size > end:
                    continue
                piece = word[end - size:end]
                if piece in scores:
                    pair = lasts[end - size], piece
                    together = pairs.get(pair)
                    if not (self._together(*pair) if together is None else together):
                        continue
                    cost = 1
                elif size == 1:
                    cost = len(piece.encode("utf-8", "surrogatepass"))
                else:
                    continue
                lasts.append(piece)
                tokens.append(tokens[end - size] + cost)
                break

    def _learn(self, words: Iterable[str]) -> None:
        """Remember the changes of the count along short words; in order, each goes on where it leaves the one before."""
        before, lasts, tokens = "", [""], [0]
        for word in sorted(words):
            same = min(len(before), len(word))
            while not word.startswith(before[:same]):
                same -= 1
            del lasts[same + 1:], tokens[same + 1:]
            self._read_on(word, lasts, tokens)
            self.steps_of[word] = bytes([(b - a) & 255 for a, b in zip(tokens, tokens[1:])])
            before = word

    def _long_word(self, word: str) -> np.ndarray:
        lasts, tokens = [""], [0]
        self._read_on(word, lasts, tokens)
        return np.diff(np.array(tokens, dtype=np.int64))

    def _block(self, words: list[str]) -> np.ndarray:
        known = self.steps_of
        rows = list(map(known.get, words))
        if None not in rows:
            return np.frombuffer(b"".join(rows), "<i1")
        return np.concatenate([np.frombuffer(row, "<i1") if row is not None else self._long_word(word)
                               for row, word in zip(rows, words)])

    def _words(self, text: str) -> list[str]:
        words = self.words.findall(text)
        new = set(words).difference(self.steps_of)
        self._learn(word for word in new if len(word) <= WORD)
        return words

    def many_steps(self, texts: list[str]) -> Iterator[np.ndarray]:
        """``steps`` of each text; what short texts have in common is learnt together."""
        short = [self.words.findall(BLANK + text.replace(" ", BLANK)) if 0 < len(text) < BLOCK else None
                 for text in texts]
        new = set(chain.from_iterable(words for words in short if words)).difference(self.steps_of)
        self._learn(word for word in new if len(word) <= WORD)
        for text, words in zip(texts, short):
            yield self.steps(text) if words is None else self._without_blank(self._block(words))
        if len(self.steps_of) > REMEMBERED:
            self.steps_of = {}

    def steps(self, text: str) -> np.ndarray:
        """For each character by how much the count of tokens changes from the prefix before it to the one with it."""
        if not text:
            return np.zeros(0, dtype="<i1")
        text, found, start = BLANK + text.replace(" ", BLANK), [], 0
        while start < len(text):
            end = start + BLOCK
            # A word ends before the first blank that follows another sign.
            cut = re.compile(f"[^{BLANK}]{BLANK}").search(text, end) if end < len(text) else None
            end = cut.start() + 1 if cut else len(text)
            block = text if not start and end == len(text) else text[start:end]
            found.append(self._block(self._words(block)))
            start = end
            if len(self.steps_of) > REMEMBERED:
                self.steps_of = {}
        return self._without_blank(np.concatenate(found) if len(found) > 1 else found[0])

    @staticmethod
    def _without_blank(steps: np.ndarray) -> np.ndarray:
        first = int(steps[0]) + int(steps[1])  # the blank put before a text
        result = steps[1:].astype("<i1" if -128 <= first < 128 and steps.itemsize == 1 else "<i4")
        result[0] = first
        return result

    def counts(self, text: str) -> np.ndarray:
        """``counts[n]``: how many tokens the first n characters give, for n from 0 to the length."""
        return np.concatenate([[0], np.cumsum(self.steps(text), dtype=np.int64)])


def stored_counts(raw: bytes, characters: int) -> np.ndarray:
    """The counts of all prefixes from stored steps; their width follows from the number of characters."""
    kind = "<i1" if len(raw) == characters else "<i4"
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, kind), dtype=np.int64)])


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; a longer prefix may have fewer tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def count_tokens(documents: DataFrame, model: str, limit: int | None = None, keep_steps: bool = True) -> DataFrame:
    """``(doc_id, text, n_bytes, n_tokens, token_steps)`` for each row; with ``limit`` also ``chars_within``.

    ``model`` is the path of a ``sentencepiece`` file, read by the driver. ``token_steps`` holds for each character
    the change of the token count, mostly one byte each; its running sum is the exact count at every prefix, from
    which ``within_budget`` and ``tokens_of_prefix`` answer later without encoding again. ``chars_within`` is
    the length of the longest prefix of at most ``limit`` tokens. Without ``keep_steps`` neither the steps nor
    the texts are returned.

    One pass in the tasks that read the texts, no shuffle. A null text counts as empty and has no tokens; rows
    with null or repeated ids are counted row by row, other columns are left behind. Long texts are
    split into words block by block.
    """
    with open(model, "rb") as file:
        definition = file.read()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(definition)
        for batch in in_pieces(batches, "text", 4 << 20):
            totals, raws, within = [], [], []
            for steps in counter.many_steps([text or "" for text in batch["text"].to_pylist()]):
                total = int(steps.sum(dtype=np.int64))
                totals.append(total)
                if keep_steps:
                    raws.append(steps.tobytes())
                if limit is not None:
                    # A text of few bytes cannot pass the limit: each character starts four tokens at most.
                    within.append(len(steps) if total <= limit else longest_within(
                        np.concatenate([[0], np.cumsum(steps, dtype=np.int64)]), limit))
            columns = [batch["doc_id"], batch["n_bytes"], pa.array(totals, pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens"]
            if keep_steps:
                columns, names = [*columns, batch["text"], pa.array(raws, pa.binary())], [*names, "text", "token_steps"]
            if limit is not None:
                columns, names = [*columns, pa.array(within, pa.int64())], [*names, "chars_within"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id long, n_bytes long, n_tokens long"
    kinds += ", text string, token_steps binary" if keep_steps else ""
    kinds += ", chars_within long" if limit is not None else ""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).mapInArrow(counted, kinds)


def within_budget(counted: DataFrame, budget: int) -> DataFrame:
    """``(doc_id, text, n_tokens)``: the longest prefix of each text of at most ``budget`` tokens, from stored steps."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals = [], []
            for text, raw in zip(batch["text"].to_pylist(), batch["token_steps"].to_pylist()):
                counts = stored_counts(raw, len(text or ""))
                size = longest_within(counts, budget)
                texts.append(None if text is None else text[:size])
                totals.append(int(counts[size]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(texts, pa.string()), pa.array(totals, pa.int64())],
                names=["doc_id", "text", "n_tokens"])

    return counted.select("doc_id", "text", "token_steps").mapInArrow(cut, "doc_id long, text string, n_tokens long")


def tokens_of_prefix(counted: DataFrame, characters: str) -> DataFrame:
    """``counted`` with ``prefix_tokens``: tokens of the first ``characters`` (a column of numbers) of each text.

    A number below 0 counts as 0, one beyond the text as its length, null gives null.
    """

    @F.pandas_udf("long")
    def tokens(lengths, raws, places):
        return type(places)([
            None if place != place or place is None else
            int(stored_counts(raw, int(length))[min(max(int(place), 0), int(length))])
            for length, raw, place in zip(lengths, raws, places)], dtype="Int64")

    return counted.withColumn("prefix_tokens", tokens(
        F.char_length(F.coalesce("text", F.lit(""))), "token_steps", F.col(characters)))

"""Packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .tokens import in_pieces

WINDOW = 2048
OPEN_WINDOWS = 16
END = 1
# Leftovers of so many partitions meet in one task.
FAN_IN = 64

# Characters on which the classes of both tokenizer libraries agree beyond doubt.
_COMMON = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "part int, left boolean, ids binary")


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def encoder(definition: str) -> Callable[[list[str]], list]:
    """From the text of a ``tokenizers`` file to a function of texts that gives lists of ids, without special tokens.

    Plain byte-level BPE is run by the faster of two libraries with the same vocabulary, wherever
    both give the same ids: on texts of common characters that spell no special token.
    """
    import tokenizers

    slow = tokenizers.Tokenizer.from_str(definition)
    known = json.loads(definition)
    special = [token["content"] for token in known.get("added_tokens") or []]
    before, model = known.get("pre_tokenizer") or {}, known["model"]
    plain = (model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
             and not before.get("add_prefix_space") and not known.get("normalizer") and not model.get("dropout")
             and not model.get("ignore_merges"))
    signs = _byte_signs()
    vocabulary = {token: n for token, n in model["vocab"].items() if token not in special} if plain else {}
    merges = [merge.split(" ") if isinstance(merge, str) else merge for merge in model["merges"]] if plain else []
    ranks = [vocabulary.get("".join(merge), -1) for merge in merges]
    if not plain or ranks != sorted(set(ranks)) or ranks[:1] == [-1]:
        return lambda texts: [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]

    import tiktoken

    # Fixed value: how byte-level tokenizers cut a text before merging.
    cuts = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("packing", pat_str=cuts, special_tokens={}, mergeable_ranks={
        bytes(signs[sign] for sign in token): n for token, n in vocabulary.items()})

    def encode(texts: list[str]) -> list:
        return [slow.encode(text, add_special_tokens=False).ids
                if _COMMON.search(text) or any(word in text for word in special) else fast.encode_ordinary(text)
                for text in texts]

    return encode


class _Windows:
    """A fixed number of open windows; pieces are collected as rows."""

    def __init__(self, part: int, window: int, count: int, keep_ids: bool, names_from: int = 0):
        self.part, self.window, self.count, self.keep_ids = part, window, count, keep_ids
        self.names_from = names_from
        self.open: list[tuple[int, list]] = []  # free tokens and pieces
        self.made = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list, left: bool = False) -> None:
        at = 0
        name = self.names_from + ((self.part << 32) | self.made)
        self.made += 1
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, name, at, self.part, left,
                              raw if left or self.keep_ids else None))
            at += len(ids)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """Best fit; if no open window has room and none may be opened, the fullest is filled up and closed."""
        total, start = len(ids), 0
        while total - start >= self.window:
            self.close([(doc, start, ids[start:start + self.window], total)])
            start += self.window
        while start < total:
            rest = total - start
            fitting = [n for n, (free, _) in enumerate(self.open) if free >= rest]
            if fitting:
                at = min(fitting, key=lambda n: self.open[n][0])
            elif len(self.open) < self.count:
                self.open.append((self.window, []))
                at = len(self.open) - 1
            else:
                at = min(range(len(self.open)), key=lambda n: self.open[n][0])
            free, pieces = self.open[at]
            size = min(free, rest)
            pieces.append((doc, start, ids[start:start + size], total))
            start += size
            if size == free:
                self.close(pieces)
                self.open.pop(at)
            else:
                self.open[at] = (free - size, pieces)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.bool_(), pa.binary()]
        names = [field.split()[0] for field in PIECES.split(", ")]
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents and their place in sequences of at most ``window`` tokens.

    ``tokenizer`` is the path of a ``tokenizers`` file, read by the driver. A document's tokens are its ids and
    then ``end``; a null text is empty. Each task keeps ``open_windows`` windows, places a document where it
    fits best, and fills the fullest by a cut when it fits nowhere. Windows still open at the end of
    a partition are laid end to end with those of ``FAN_IN`` others, round by round, so that only
    full ones leave; the very last, shorter one is cut at powers of two, which need no padding. The tokens of
    a partition never leave its task, except for those open windows.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and with ``keep_ids`` the ids,
    32-bit little-endian. Repeated rows are packed as often as they occur. No rows give no pieces.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition)
        windows = _Windows(TaskContext.get().partitionId(), window, open_windows, keep_ids)
        for batch in in_pieces(batches, "text", 4 << 20):
            texts = [text or "" for text in batch["text"].to_pylist()]
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(texts)):
                windows.add(doc, np.array([*ids, end], dtype="<u4"))
            yield windows.batch()
        for _, pieces in windows.open:
            windows.close(pieces, left=True)
        yield windows.batch()

    pieces = checkpoint(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                        .mapInArrow(packed, PIECES))
    names = [field.split()[0] for field in PIECES.split(", ")][:7] + (["ids"] if keep_ids else [])
    result = [pieces.where("not left").select(names)]
    left = pieces.where("left")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    tries = 0
    while True:
        tries += 1
        last = parts <= FAN_IN
        left = checkpoint(left.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
                          .groupBy("part").applyInArrow(_merge(window, tries << 56, last, keep_ids), PIECES))
        result.append(left.where("not left").select(names))
        if last:
            break
        left, parts = left.where("left"), -(-parts // FAN_IN)
    whole = result[0]
    for more in result[1:]:
        whole = whole.unionByName(more)
    return whole


def _merge(window: int, names_from: int, last: bool, keep_ids: bool):
    def merged(table: pa.Table) -> pa.Table:
        # Ids stay Arrow numbers and Python's: pandas would turn them into floats where one is null.
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        windows = _Windows(table["part"][0].as_py(), window, 1, keep_ids, names_from)
        room, pieces = window, []
        queue = [(doc, start, np.frombuffer(ids, dtype="<u4"), total) for doc, start, ids, total in zip(
            *[table[name].to_pylist() for name in ("doc_id", "start", "ids", "doc_tokens")])]
        size_left = sum(len(ids) for _, _, ids, _ in queue)
        room = _next_size(window, size_left, last)
        for doc, start, ids, total in queue:
            while len(ids):
                head, ids = ids[:room], ids[room:]
                pieces.append((doc, start, head, total))
                start, room, size_left = start + len(head), room - len(head), size_left - len(head)
                if not room:
                    windows.close(pieces)
                    pieces, room = [], _next_size(window, size_left, last)
        if pieces:
            windows.close(pieces, left=True)
        return pa.Table.from_batches([windows.batch()])

    return merged


def _next_size(window: int, left: int, last: bool) -> int:
    """Tokens of the next sequence: full, or at the very end the largest power of two that can be filled."""
    return window if left >= window or not last or not left else 1 << (left.bit_length() - 1)

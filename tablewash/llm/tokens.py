"""Words of whole batches of texts as numbers, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(starts, codes, words)``: the words of text i are ``words[codes[starts[i]:starts[i + 1]]]``, as bytes.

    Words are runs of anything but the six ASCII white-space characters, which is what ``bytes.split``
    cuts at; only A-Z is lower-cased. A null text has no words.
    """
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()
    lists = [text.lower().split() for text in raw] if lower else [text.split() for text in raw]
    starts = np.concatenate([[0], np.cumsum([len(words) for words in lists])]).astype(np.int64)
    flat = pa.array(list(chain.from_iterable(lists)), pa.large_binary()).dictionary_encode()
    return starts, flat.indices.to_numpy(zero_copy_only=False), flat.dictionary


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``size`` bytes of ``column``, but at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        place = np.cumsum(lengths) // size
        cuts = np.flatnonzero(np.diff(place)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, end - start)


def row_of(starts: np.ndarray) -> np.ndarray:
    """For each word the number of the text it belongs to."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))

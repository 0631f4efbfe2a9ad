"""Words of whole texts as spans over the bytes of an Arrow batch.

A-Z are lower-cased; a word is a run of digits, a-z and characters beyond ASCII ([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+), which in
UTF-8 is a run of bytes of those classes. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


class Words(NamedTuple):
    """data: the texts' folded bytes; word k is data[start[k]:end[k]]; text i has the words first[i]:first[i + 1] and begins at at[i]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray


def words(texts: pa.Array) -> Words:
    """The words of every text of an Arrow column of strings; no word passes from one text into the next."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, places, held = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    data = _FOLD[raw]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _INSIDE[data]
    begins, ends = inside.copy(), inside[:-1] & ~inside[1:]
    begins[1:] &= ~inside[:-1]
    cuts = at[(at > 0) & (at < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins[:-1])
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at), at)


def portions(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of about most bytes of a text column, one row at least, as arrays take several bytes a byte."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in slices(size, most):
        yield batch.slice(a, b - a)


def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after another."""
    at = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(at - start, size)


def slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges (a, b) of spans that hold about most bytes each, one span at least."""
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


def joined(found: Words) -> Words:
    """The same words with one space after each, so that a run of words is one span."""
    size = found.end - found.start
    data = np.full(int(size.sum()) + len(size), ord(" "), np.uint8)
    start = np.cumsum(size + 1) - size - 1
    for a, b in slices(size, 1 << 20):
        data[flat(start[a:b], size[a:b])] = found.data[flat(found.start[a:b], size[a:b])]
    return Words(data, start, start + size, found.first, found.at)

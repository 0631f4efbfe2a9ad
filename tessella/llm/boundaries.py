"""A sorted set of offsets in containers, of which the k-th is found without the others.

Offsets share a container by all but their 16 low bits. A container is an array of low bits, a bitmap, or runs of
consecutive ones, whichever is smallest; cumulative cardinalities name the container of the k-th offset, and a
selection inside gives it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Offsets that one container spans.
SPAN = 1 << 16


class Array:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.bits = np.packbits(bits, bitorder="little")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits.view(np.uint64)), dtype=np.int32)])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bits[8 * word : 8 * word + 8], bitorder="little"))
        return 64 * word + int(inside[k - self.before[word]])


class Runs:
    def __init__(self, first: np.ndarray, size: np.ndarray):
        self.first, self.before = first.astype(np.uint16), np.concatenate([[0], np.cumsum(size, dtype=np.int32)])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of sorted distinct low bits: two bytes an offset, four a run, or a bit for each possible one."""
    heads = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(heads) < min(2 * len(low), SPAN // 8):
        return Runs(low[heads], np.diff(heads, append=len(low)))
    return Array(low) if 2 * len(low) <= SPAN // 8 else Bitmap(low)


class Boundaries:
    """Offsets from 0 on, added container by container in rising order."""

    def __init__(self):
        self.number: list[int] = []
        self.containers: list[Array | Bitmap | Runs] = []
        self.total: list[int] = []

    def __len__(self) -> int:
        return self.total[-1] if self.total else 0

    def add(self, number: int, low: np.ndarray) -> None:
        """The offsets number * SPAN + low."""
        if len(low):
            self.number.append(number)
            self.containers.append(container(low))
            self.total.append(len(self) + len(low))

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = bisect_left(self.total, k + 1)
        return self.number[at] * SPAN + self.containers[at].select(k - (self.total[at - 1] if at else 0))

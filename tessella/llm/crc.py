"""CRC-32 of many spans of bytes at once.

The checksum is linear but for a constant of the length: every byte contributes what a table holds for its value and its
distance from the span's end, contributions are XORed (bitwise_xor.reduceat over all spans), and the length's constant is XORed
in. Spans longer than the table fold blockwise: a block's sum is moved on by the blocks behind it, by powers of two.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

from tessella.llm.words import flat, slices

#: Distances from the end that the table holds, which is a block's length too.
BLOCK = 64
#: Bytes whose contributions are held at a time.
HELD = 1 << 20


def _table() -> np.ndarray:
    """Contribution of each byte value at each distance from the end."""
    none = zlib.crc32(b"\0")
    rows = [np.array([zlib.crc32(bytes([b])) ^ none for b in range(256)], np.uint32)]
    for _ in range(BLOCK - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ rows[0][rows[-1] & np.uint32(255)])
    return np.stack(rows)


_TABLE = _table()
_FLAT = _TABLE.ravel()
#: The register after so many zero bytes, from all ones.
_ZEROS = np.array([zlib.crc32(bytes(n)) ^ 0xFFFFFFFF for n in range(BLOCK)], np.uint32)


@functools.cache
def _moves(power: int) -> np.ndarray:
    """Moving a register on by BLOCK * 2**power zero bytes: what each of its four bytes becomes."""
    base = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    if power:
        return _moved_once(_moved_once(base, power - 1), power - 1)
    for _ in range(BLOCK):
        base = (base >> np.uint32(8)) ^ _TABLE[0][base & np.uint32(255)]
    return base


def _moved_once(values: np.ndarray, power: int) -> np.ndarray:
    table = _moves(power)
    return table[0][values & 255] ^ table[1][values >> 8 & 255] ^ table[2][values >> 16 & 255] ^ table[3][values >> 24]


def _moved(values: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Registers moved on by so many blocks of zero bytes each."""
    values, power = values.copy(), 0
    while len(blocks) and (left := blocks >> power).any():
        odd = np.flatnonzero(left & 1)
        values[odd] = _moved_once(values[odd], power)
        power += 1
    return values


def _sums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XORed contributions of spans of 1 to BLOCK bytes."""
    out = np.empty(len(start), np.uint32)
    for a, b in slices(size, HELD):
        n = size[a:b]
        places = flat(start[a:b], n)
        far = np.repeat(start[a:b] + n - 1, n) - places
        out[a:b] = np.bitwise_xor.reduceat(_FLAT[far << 8 | data[places]], np.cumsum(n) - n)
    return out


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each data[start:end]; spans may overlap, an empty one gives 0."""
    size, out = end - start, np.zeros(len(start), np.uint32)
    short = np.flatnonzero((size > 0) & (size <= BLOCK))
    out[short] = _sums(data, start[short], size[short])
    long = np.flatnonzero(size > BLOCK)
    if len(long):
        count = -(-size[long] // BLOCK)
        first = np.cumsum(count) - count
        # a span's first block is the partial one
        behind = np.repeat(count, count) - 1 - (np.arange(count.sum()) - np.repeat(first, count))
        stop = np.repeat(end[long], count) - behind * BLOCK
        begin = np.maximum(np.repeat(start[long], count), stop - BLOCK)
        out[long] = np.bitwise_xor.reduceat(_moved(_sums(data, begin, stop - begin), behind), first)
    return out ^ _moved(_ZEROS[size % BLOCK], size // BLOCK) ^ np.uint32(0xFFFFFFFF)

"""Whole-text encoding inside tasks.

Byte-level BPE cuts a text by a pattern and encodes the pieces one by one, so a text's ids are its pieces' ids, one after
another. numpy finds the pieces' starts from a class a byte, as the tokenizer's own pattern does; each Python worker keeps
the ids of the pieces it has met, asks the tokenizer only for new ones, and gathers whole slices of texts. Texts for which
numpy's cut might differ from the pattern's (rare scripts, unusual white space, special tokens) go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers; beyond it all are forgotten and met anew.
MEMORY = 600_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 2 << 20
#: New pieces that are given to the tokenizer as one line each of one string.
LINES = 64
#: Longer pieces aren't remembered.
LONGEST = 32

_LETTER, _DIGIT, _BLANK, _SPACE, _OTHER = range(5)
#: Code points up to here are cut by class; beyond it only the punctuation U+2010 to U+2027 and the euro sign.
_LAST = 0x52F


def _class_of(code: int) -> int:
    kind = unicodedata.category(chr(code))[0]
    return _LETTER if kind == "L" else _DIGIT if kind == "N" else _OTHER


_CLASSES = np.array([_class_of(c) for c in range(_LAST + 1)], np.uint8)
_CLASSES[[9, 10, 13]], _CLASSES[32] = _SPACE, _BLANK
_BYTES = np.concatenate([_CLASSES[:128], np.full(128, _OTHER, np.uint8)])
#: Bytes that stand in no text that is cut by class: controls that a pattern may take for white space, and leads beyond U+052F but E2.
_ODD = np.zeros(256, bool)
_ODD[[0, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_ODD[0xD5:] = True
_ODD[0xE2] = False
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, (2, LONGEST // 8 + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _odd_places(data: np.ndarray) -> np.ndarray:
    """Where data (UTF-8) has a character that isn't cut by class."""
    found = [np.flatnonzero(_ODD[data])]
    for lead in (0xC2, 0xD4, 0xE2):
        at = np.flatnonzero(data == lead)
        after = data[at + 1]
        if lead == 0xC2:
            bad = (after == 0x85) | (after == 0xA0)
        elif lead == 0xD4:
            bad = after > 0xAF
        else:
            last = data[at + 2]
            bad = ~(((after == 0x80) & (last >= 0x90) & (last <= 0xA7)) | ((after == 0x82) & (last == 0xAC)))
        found.append(at[bad])
    return np.concatenate(found)


def starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that stand one after another in data, from bounds[k] to bounds[k + 1]."""
    n = len(data)
    kinds = _BYTES[data]
    leads = np.flatnonzero((data >= 0xC2) & (data <= 0xD4))
    kinds[leads] = kinds[leads + 1] = _CLASSES[(data[leads].astype(np.int64) & 0x1F) << 6 | data[leads + 1] & 0x3F]
    white = (kinds == _BLANK) | (kinds == _SPACE)
    first, last = np.zeros(n + 1, bool), np.zeros(n, bool)
    first[bounds] = True
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    first = first[:n]
    begin = first.copy()
    # a word begins where the class changes, but for a blank before it, which belongs to it
    begin[1:] |= ~white[1:] & (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _BLANK)
    # a run of white space begins after a word; its last character stands alone or with the word after it
    begin[1:] |= white[1:] & ~white[:-1]
    begin[:-1] |= white[:-1] & ~white[1:] & ~last[:-1]
    quotes = np.flatnonzero(begin & (data == 39))
    if len(quotes):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        ends = np.concatenate([first, np.ones(3, bool)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = ~ends[quotes + 1] & ((one == 115) | (one == 116) | (one == 109) | (one == 100))  # 's 't 'm 'd
        pair = ~ends[quotes + 1] & ~ends[quotes + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))  # 're 've 'll
        begin[quotes[short | pair] + 1] = False
        after = np.concatenate([quotes[short] + 2, quotes[pair] + 3])
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    """encode(texts) gives the ids of all texts in one array, and where each text's ids start."""

    def __init__(self, path: str):
        # a task is one of many on its machine; threads of its own would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.check = np.zeros(0, np.uint64)
        self.tables: list[pd.Index] = []

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, one after another, and their numbers."""
        # a piece is white space or has none but a blank before it; the latter go as lines, whose ends' id stands between two
        blank = np.fromiter(map(str.isspace, pieces), bool, len(pieces))
        order = np.argsort(blank, kind="stable")
        lines, white = [pieces[i] for i in order[: len(pieces) - blank.sum()]], [pieces[i] for i in np.flatnonzero(blank)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)]
        sizes = np.zeros(len(pieces), np.int64)
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        for i in range(0, len(lines), LINES * 64):
            part = lines[i : i + LINES * 64]
            texts = ["\n".join(part[j : j + LINES]) for j in range(0, len(part), LINES)]
            flat = np.concatenate([np.array([*e.ids, self.newline], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            stops = np.flatnonzero(flat == self.newline)
            if len(stops) != len(part):
                raise ValueError("the tokenizer joins lines")
            counts.append(np.diff(stops, prepend=-1) - 1)
            out.append(np.delete(flat, stops))
        for p in white:
            out.append(np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32))
            counts.append(np.array([len(out[-1])]))
        sizes[order] = np.concatenate(counts)
        flat, back = np.concatenate(out), np.argsort(order)
        began = np.cumsum(sizes[order]) - sizes[order]
        return _gather(flat, began[back], sizes), sizes

    def look(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The remembered pieces' numbers, -1 for others. Two hashes of 64 bits must agree."""
        found, first = np.full(len(keys), -1, np.int64), 0
        for table in self.tables:
            missing = np.flatnonzero(found < 0)
            at = table.get_indexer(keys[missing])
            hit = at >= 0
            found[missing[hit]] = at[hit] + first
            first += len(table)
        known = np.flatnonzero(found >= 0)
        found[known[self.check[found[known]] != check[known]]] = -1
        return found

    def remember(self, keys: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add new pieces; a few tables of growing length are kept, each with its own hash table."""
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size, self.check, self.pool = np.concatenate([self.size, sizes]), np.concatenate([self.check, check]), np.concatenate([self.pool, ids])
        self.tables.append(pd.Index(keys))
        while len(self.tables) > 1 and len(self.tables[-1]) * 4 > len(self.tables[-2]):
            last = self.tables.pop()
            self.tables[-1] = pd.Index(np.concatenate([self.tables[-1].to_numpy(), last.to_numpy()]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = texts.cast(pa.large_string())
        data, bounds = _bytes(rows)
        odd = np.zeros(len(rows), bool)
        odd[np.searchsorted(bounds, _odd_places(data), "right") - 1] = True
        for s in self.special:
            odd |= np.asarray(pc.match_substring(rows, s).to_numpy(zero_copy_only=False), bool)
        whole = []
        if odd.any():
            whole = rows.filter(pa.array(odd)).to_pylist()
            data, bounds = _bytes(rows.filter(pa.array(~odd)))
        if len(self.size) > MEMORY:
            self.forget()
        begin = starts(data, bounds)
        pool, start, sizes = self.pieces(data, begin, np.diff(begin, append=len(data)))
        # pieces of each text; an odd text is one piece of its own
        counts = np.ones(len(rows), np.int64)
        counts[~odd] = np.diff(np.searchsorted(begin, bounds))
        if whole:
            more = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            size = np.array([len(m) for m in more], np.int64)
            own = np.repeat(~odd, counts)
            both = np.empty((2, len(own)), np.int64)
            both[:, own], both[:, ~own] = (start, sizes), (len(pool) + np.cumsum(size) - size, size)
            pool, (start, sizes) = np.concatenate([pool, *more]), both
        stops = np.concatenate([[0], np.cumsum(sizes)])
        return _gather(pool, start, sizes), stops[np.concatenate([[0], np.cumsum(counts)])]

    def pieces(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each piece's begin and how many it has."""
        padded = np.concatenate([data, np.zeros(LONGEST, np.uint8)])
        words = np.ndarray(len(data) + LONGEST - 7, "<u8", padded, strides=(1,))
        hashed = np.zeros((2, len(begin)), np.uint64)
        for k in range(LONGEST // 8):
            use = slice(None) if k == 0 else np.flatnonzero(length > 8 * k)
            left = np.minimum(length[use] - 8 * k, 8).astype(np.uint64)
            word = words[begin[use] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
            for h, factors in zip(hashed, _FACTORS, strict=True):
                h[use] = (h[use] ^ (h[use] >> np.uint64(29))) * factors[-1] + word * factors[k]
        found = self.look(*hashed)
        found[length > LONGEST] = -1
        fresh = np.flatnonzero(found < 0)
        if not len(fresh):
            return self.pool, self.start[found], self.size[found]
        edges = np.stack([begin[fresh], begin[fresh] + length[fresh]], 1)
        named = _strings(padded, edges).dictionary_encode()
        new, code = named.dictionary.to_pylist(), np.asarray(named.indices)
        ids, sizes = self.learn(new)
        one = np.empty(len(new), np.int64)
        one[code] = fresh
        base = len(self.pool)
        begun, size = np.cumsum(sizes) - sizes, np.zeros(len(begin), np.int64)
        start = np.zeros(len(begin), np.int64)
        known = np.flatnonzero(found >= 0)
        start[known], size[known] = self.start[found[known]], self.size[found[known]]
        start[fresh], size[fresh] = base + begun[code], sizes[code]
        pool = np.concatenate([self.pool, ids])
        # pieces that agree in the first hash only with a remembered one stay unknown, and long ones aren't remembered
        keys, check = hashed[0][one], hashed[1][one]
        take = (length[one] <= LONGEST) & (self.look(keys, check) < 0)
        for table in self.tables:
            take &= table.get_indexer(keys) < 0
        take &= np.isin(np.arange(len(keys)), np.unique(keys, return_index=True)[1])
        self.remember(keys[take], check[take], _gather(ids, begun[take], sizes[take]), sizes[take])
        return pool, start, size


def _bytes(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings without nulls, and where each begins and the last ends."""
    _, places, held = rows.buffers()
    at = np.frombuffer(places, np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def _strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Strings of the stretches edges (n, 2) of data."""
    size = edges[:, 1] - edges[:, 0]
    held = _gather(data, edges[:, 0], size)
    return pa.Array.from_buffers(pa.large_string(), len(edges), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(held)])


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of all, one after another."""
    ends = np.cumsum(size)
    kind = np.int32 if len(pool) + (ends[-1] if len(ends) else 0) < 1 << 31 else np.int64
    at = np.repeat((start - (ends - size)).astype(kind), size)
    at += np.arange(len(at), dtype=kind)
    return pool[at]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(ids: pa.Array, texts: pa.Array, path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Slices of about SLICE_BYTES: the documents' own ids, all token ids, and offsets (one more than documents). Null texts count as empty."""
    enc = encoder(path)
    texts = texts.fill_null("")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    i, done = 0, 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, done + SLICE_BYTES)))
        flat, at = enc.encode(texts.slice(i, j - i))
        yield ids.slice(i, j - i).to_pylist(), flat, at
        i, done = j, int(ends[j - 1])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

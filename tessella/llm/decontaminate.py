"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

A task streams the words of its texts through the automaton (automaton.py), which holds the longest stretch of any item that ends
at each word; where it reaches a window's length, the window's words are hit. Words are streamed only where they can matter: a
pair of neighbours that no item has is told by a bit table of the items' pairs, and there the longest match is one word or
none, so stretches between such places are streamed apart, and those shorter than the shortest window not at all. The table
only rules out; what it lets through is compared word by word.

Items are cut into stretches that overlap by a window, dealt into parts of at most PART_WORDS words, and every part is a pass
over the texts with an automaton of its own, which is all that is sent to the tasks. The driver holds one part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.automaton import Automaton
from tessella.llm.common import fresh, materialize, numbered
from tessella.llm.words import Words, flat, portions, slices, words

WINDOW = 10
#: Words of one automaton at most, and of a stretch of an item.
PART_WORDS, STRETCH = 100_000, 4_000
#: Bytes from which a word is known by its digest, so that a part's size is bounded in bytes too.
LONG = 64
_BITS = 22
_R = np.random.default_rng(12).integers(0, 1 << 63, LONG + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPANS = "_begin array<long>, _end array<long>"


def keys(found: Words) -> np.ndarray:
    """A 64-bit hash of each word; words over LONG bytes share one."""
    size, out = found.end - found.start, np.full(len(found.start), _R[LONG])
    known = np.flatnonzero(size <= LONG)
    for a, b in slices(size[known], 1 << 20):
        at, n = found.start[known[a:b]], size[known[a:b]]
        places = flat(at, n)
        far = np.repeat(at + n - 1, n) - places
        out[known[a:b]] = np.add.reduceat((found.data[places].astype(np.uint64) + np.uint64(1)) * _R[far], np.cumsum(n) - n)
    return (out ^ out >> np.uint64(31)) * _R[0]


def _pairs(key: np.ndarray) -> np.ndarray:
    mixed = (key[:-1] * _R[1] + key[1:]) * _R[2]
    return (mixed >> np.uint64(64 - _BITS)).astype(np.int64)


def _named(data: bytes) -> bytes:
    """A word, or a digest that no word equals."""
    return data if len(data) <= LONG else b"\0" + hashlib.blake2b(data, digest_size=16).hexdigest().encode()


def _texts(found: Words, a: int, b: int) -> list[bytes]:
    data = found.data[found.start[a] : found.end[b - 1]].tobytes() if b > a else b""
    base = found.start[a] if b > a else 0
    return [_named(data[s:e]) for s, e in zip((found.start[a:b] - base).tolist(), (found.end[a:b] - base).tolist(), strict=True)]


class _Part:
    """An automaton of some stretches of items and the bit tables of their words and pairs."""

    def __init__(self, stretches: list[tuple[str | None, list[bytes], np.ndarray]], window: int):
        self.automaton = Automaton(window)
        self.word, self.pair = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
        self.least = min((len(t) for _, t, _ in stretches), default=window)
        self.least = min(self.least, window)
        for _, text, key in stretches:
            self.automaton.add(text)
            self.word[(key >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.pair[_pairs(key)] = True
        for item, text, _ in stretches:
            self.automaton.name(text, item)

    def runs(self, found: Words) -> list[tuple[int, int]]:
        """Words (a, b) whose neighbours the items may hold, of the shortest window's length or more, none across texts."""
        key = keys(found)
        if not len(key):
            return []
        joins = self.pair[_pairs(key)]
        heads = found.first[(found.first > 0) & (found.first < len(key))]
        joins[heads - 1] = False
        begin = np.concatenate([[0], np.flatnonzero(~joins) + 1])
        end = np.concatenate([begin[1:], [len(key)]])
        keep = end - begin >= self.least
        if self.least == 1:
            keep &= self.word[(key[begin] >> np.uint64(64 - _BITS)).astype(np.int64)]
        return list(zip(begin[keep].tolist(), end[keep].tolist(), strict=True))


def stretches(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (as a string), words (joined by spaces), keys of the items' stretches; items without words give none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = words(batch.column(1)), []
            key = keys(found)
            for i, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(found.first[i]), int(found.first[i + 1])
                while a < b:
                    c = min(b, a + max(STRETCH, 2 * window))
                    rows.append((item, b" ".join(_texts(found, a, c)), key[a:c].tobytes(), c - a))
                    a = b if c == b else c - window + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary(), pa.int64()))], names=["item", "words", "keys", "n"])

    return items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(cut, "item string, words binary, keys binary, n long")


def _parts(items: DataFrame, window: int) -> Iterator[_Part]:
    """The items' automata, one after another; one without items if there are none."""
    held = materialize(stretches(items, window).withColumn("_row", F.monotonically_increasing_id()))
    total, dealt = held.agg(F.sum("n")).first()[0] or 0, None
    buckets = max(1, -(-total * 8 // PART_WORDS))
    while dealt is None:  # a bucket holds an eighth of a part on average
        sizes = held.groupBy(F.pmod(F.xxhash64("_row"), F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n")).collect()
        dealt = sizes if all(r["n"] <= PART_WORDS for r in sizes) else None
        buckets = buckets if dealt is not None else 2 * buckets
    groups, size = [[]], 0
    for r in sorted(dealt, key=lambda r: r["bucket"]):
        if size + r["n"] > PART_WORDS:
            groups.append([])
            size = 0
        groups[-1].append(r["bucket"])
        size += r["n"]
    for group in groups:
        rows = held.filter(F.pmod(F.xxhash64("_row"), F.lit(buckets)).isin(group)).collect() if group else []
        yield _Part([(r["item"], bytes(r["words"]).split(b" "), np.frombuffer(bytes(r["keys"]), np.uint64)) for r in rows], window)


def _pass(rows: DataFrame, part: _Part, key: str, every: bool) -> DataFrame:
    """doc_id, n_words, the stretches of words and of bytes that are hit, the items, and the row's key, of every row or of those hit."""
    sent = rows.sparkSession.sparkContext.broadcast(part)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in (part for whole in batches for part in portions(whole, 1)):
            found = words(batch.column(1))
            out = [([], [], [], [], set()) for _ in range(batch.num_rows)]
            for a, b in own.runs(found):
                spans, items = own.automaton.found(_texts(found, a, b))
                if spans:
                    i = int(np.searchsorted(found.first, a, "right")) - 1
                    for x, y in spans:
                        for values, value in zip(out[i], (a + x - found.first[i], a + y - found.first[i], found.start[a + x] - found.at[i], found.end[a + y - 1] - found.at[i]), strict=False):
                            values.append(int(value))
                    out[i][4].update(items)
            n, lists = pa.array(np.diff(found.first).astype(np.int64)), pa.list_(pa.int64())
            columns = [pa.array([o[k] for o in out], lists) for k in range(4)] + [pa.array([[x for x in sorted(o[4], key=str) if x is not None] for o in out], pa.list_(pa.string()))]
            whole = pa.RecordBatch.from_arrays([batch.column(0), n, *columns, batch.column(2)], names=["doc_id", "n_words", "begins", "ends", "from", "to", "items", "key"])
            yield whole if every else whole.filter(pa.array([bool(o[0]) for o in out], pa.bool_()))

    kind = rows.schema[key].dataType.simpleString()
    return rows.select("doc_id", "text", key).mapInArrow(stream, f"doc_id long, n_words long, begins array<long>, ends array<long>, from array<long>, to array<long>, items array<string>, key {kind}")


def _united(begin: str, end: str) -> F.Column:
    """Sorted disjoint spans of two lists of begins and ends that may overlap, as an array of (begin, end)."""
    span = F.array_sort(F.arrays_zip(F.col(begin).alias("a"), F.col(end).alias("b")))
    last = lambda acc: F.element_at(acc, -1)
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return F.aggregate(span, none, lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["b"] >= s["a"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["a"].alias("a"), F.greatest(last(acc)["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))))


def _hits(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame, str]:
    """The docs with a key of each row, its column, and doc_id, n_words, words and bytes (spans), items, key of every row."""
    rows, key = numbered(docs)
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key)
    passes = []
    for part in _parts(items, window):
        if passes:  # the pass before is run and written before the driver holds another part
            passes[-1] = materialize(passes[-1])
        passes.append(_pass(texts, part, key, not passes))
    found = passes[0]
    if len(passes) > 1:
        for later in passes[1:]:
            found = found.unionByName(later)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends", "from", "to", "items")]
        found = found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists).withColumn("items", F.array_distinct("items"))
    spans = found.withColumns({"words": _united("begins", "ends"), "bytes": _united("from", "to")}) if len(passes) > 1 else found.withColumns({"words": F.arrays_zip(F.col("begins").alias("a"), F.col("ends").alias("b")), "bytes": F.arrays_zip(F.col("from").alias("a"), F.col("to").alias("b"))})
    return rows, spans.select("doc_id", "n_words", "words", "bytes", "items", "key"), key


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, words, items.

    A word is hit inside any occurrence of a window of items (item_id, text): window consecutive words of an item, or all
    words of an item of fewer. words: the hit stretches (a to b, from 0); items: the sorted ids, as strings, whose digest is
    items_sha256 (joined by commas). A null text has no words; a null item_id marks words but isn't named or counted, items that
    repeat an id are one item, and those without words match nothing; null and repeated doc_ids are rows like any; an empty
    table gives no rows; other columns are ignored. A text's arrays are held whole, about ten bytes a byte.
    """
    _, found, _ = _hits(docs, items, window)
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("words") > 0).alias("contaminated"), "words", F.array_sort("items").alias("items"))


def removed(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int | None = None, share: float = 0.5) -> DataFrame:
    """docs with all its columns, the hit spans cut out of text.

    Rows of which more than share of the words are hit go whole, as do those with a hit stretch of more than longest words, if
    it is given. What is cut leaves the text around it as it was; rows without a hit stay as they are, null texts too.
    """
    rows, found, key = _hits(docs, items, window)
    n = F.aggregate("words", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    over = n > share * F.col("n_words")
    if longest is not None:
        over |= F.exists("words", lambda s: s["b"] - s["a"] > longest)
    spans, gone = fresh(docs, "_spans"), fresh(docs, "_gone")
    marks = materialize(found.filter(F.size("words") > 0).select(F.col("key").alias(key), F.col("bytes").alias(spans), over.alias(gone)))
    joined = rows.join(marks, key, "left").filter(~F.coalesce(F.col(gone), F.lit(False)))
    clean = joined.filter(F.col(spans).isNull()).select(docs.columns)
    data, hold = F.col("text").cast("binary"), F.col(spans)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(hold, lambda s: s["b"]))
    ends = F.concat(F.transform(hold, lambda s: s["a"]), F.array(F.octet_length("text").cast("long")))
    left = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda s: F.substring(data, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")).cast("string"))
    return clean.unionByName(joined.filter(F.col(spans).isNotNull()).withColumn("text", F.array_join(left, "")).select(docs.columns))


__all__ = ["contaminated", "removed", "stretches"]

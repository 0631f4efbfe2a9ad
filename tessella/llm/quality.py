"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are taken inside tasks; trees are grown on the driver from a bounded sample of labelled rows and flattened
into arrays, which tasks traverse level by level for all rows and trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import below, materialize
from tessella.llm.language import held_out

#: Labelled rows that are fitted at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 48, 80, 4, 0.12, 8, 1.0
THRESHOLD = 0.7

NAMES = (
    "log_bytes log_words log_lines upper lower digit blank non_ascii punct bang pipe hash_sign at_sign slash colon brace angle quote comma stop "
    "entropy word_mean word_std word_long word_short unique_words unique_lines line_mean line_std short_lines end_stop upper_lines repeat_pairs digit_words"
).split()


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_UPPER, _LOWER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_HIGH = (np.arange(256) >= 128).astype(float)
_PUNCT = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)], float)
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _class(" \t\n\r\x0b\x0c"), _HIGH, _PUNCT, _class("!"), _class("|"), _class("#"), _class("@"), _class("/\\"), _class(":;"), _class("{}[]()"), _class("<>"), _class("\"'"), _class(","), _class(".")])


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; an empty one has zeros."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(len(NAMES), np.float32)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    if not words:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / len(data)
    some = share[share > 0]
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    widths = np.fromiter(map(len, lines), np.float64, len(lines))
    out[:3] = np.log1p([len(data), len(words), len(lines)])
    out[3 : 3 + len(_CLASSES)] = _CLASSES @ share
    pairs = len(set(zip(words, words[1:])))
    out[3 + len(_CLASSES) :] = [
        -(some * np.log2(some)).sum(), sizes.mean(), sizes.std(), (sizes > 15).mean(), (sizes <= 3).mean(), len(set(words)) / len(words), len(set(lines)) / len(lines),
        np.log1p(widths.mean()), np.log1p(widths.std()), (widths < 40).mean(), sum(x.endswith(b".") for x in lines) / len(lines), sum(x.isupper() for x in lines) / len(lines),
        pairs / max(1, len(words) - 1), sum(map(bytes.isdigit, words)) / len(words),
    ]
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([statistics(t.as_py()) for t in batch.column(1)]) if len(batch) else np.zeros((0, len(NAMES)), np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(NAMES), dtype=np.int32), pa.array(rows.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Forest:
    """Complete trees of one depth in arrays: node k's children are 2k + 1 and 2k + 2; a leaf's value stands below the last level."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of all rows."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees, rows = np.arange(len(self.feature))[:, None], np.arange(len(x))[None, :]
        node = np.zeros((len(self.feature), len(x)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        margin = self.base + self.value[trees, node - (2**self.depth - 1)].sum(0)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boost log-loss with histogram splits: quantile bins once, then per level one histogram of gradients a feature."""
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    empty = Forest(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), base, depth)
    if not len(y) or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            gain_best, where = np.full(width, 1e-6), [(0, np.inf)] * width
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                slot, size = local * bins + binned[f], width * bins
                g, h, c = (np.bincount(slot, w, size).reshape(width, bins).cumsum(1) for w in (grad, curve, None))
                gl, hl, cl = g[:, :-1], h[:, :-1], c[:, :-1]
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(cl < LEAST_ROWS) | (ct - cl < LEAST_ROWS)] = -1
                gain = gain[:, : len(edges[f])]
                best = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), best] > gain_best):
                    gain_best[k], where[k] = gain[k, best[k]], (f, float(edges[f][best[k]]))
            for k, (f, t) in enumerate(where):
                feature[first + k], threshold[first + k] = f, t
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = RATE * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, curve, 2**depth) + RIDGE)
        margin += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(values), base, depth)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, quality 0 or 1.

    Learns only from rows that aren't held out (crc32 of doc_id mod 4 is 2) and at most sample of them; null labels teach
    nothing. Null and empty texts are scored by zero statistics; without labels of both kinds all rows score the labels'
    rate (1/2 without any); an empty table gives no rows; repeated rows are scored one by one; other columns are ignored.
    """
    rows = materialize(features(docs))
    out = held_out(2, 4)
    taught = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter(~out)
    picked = rows.join(below(taught, 5, sample), "doc_id").orderBy("_hash", "doc_id").limit(sample).select("x", "quality").collect()
    x = np.array([r["x"] for r in picked], np.float32).reshape(-1, len(NAMES))
    forest = fit(x, np.array([r["quality"] for r in picked], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(NAMES))
            score = np.concatenate([forest.score(x[i : i + 2048]) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

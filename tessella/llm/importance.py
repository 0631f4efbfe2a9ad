"""Importance resampling towards a target distribution.

Features are runs of words, counted in buckets by CRC-32 (crc.py). A bucket's gain is the smoothed log ratio of its share in the
target to its share in the corpus; a document's weight is the sum of its features' gains; Gumbel noise from a hash of its id turns
the largest scores into a draw without replacement in proportion to the weights.

Two passes over the texts: tasks first send one count a bucket, then weigh their documents by the gains, of which there are as
many as buckets. Ranks come from ranges of scores: rows are range-partitioned by score and id, ranges counted, and only the
ranges that the draw reaches are numbered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded, materialize, numbered
from tessella.llm.crc import crc32
from tessella.llm.words import Words, joined, portions, words

BUCKETS = 10_000
SEED = "2024"


def features(found: Words, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and first word of each feature, for runs of 1, 2, ... words that stay within a text."""
    if runs > 1:
        found = joined(found)
    for n in range(1, runs + 1):
        last = np.repeat(found.first[1:], np.diff(found.first))
        begin = np.flatnonzero(np.arange(len(found.start)) + n <= last)
        yield (crc32(found.data, found.start[begin], found.end[begin + n - 1]) % buckets).astype(np.int64), begin


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts each bucket holds; a task sends one row a bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in portions(batch, 0):
                for bucket, _ in features(words(part.column(0)), runs, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    sums = texts.select(F.col(text_col).cast("string")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # as many rows as buckets at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of (t + 1) * (S + buckets) / ((s + 1) * (T + buckets))) of each bucket, in doubles."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(rows: DataFrame, gain: np.ndarray, runs: int, carried: str) -> DataFrame:
    """doc_id, n_words, n_features, weight and what is carried; rows: doc_id, text, the carried column."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            found = words(batch.column(1))
            n, own = np.diff(found.first), np.zeros(len(found.start) + 1, np.int64)
            number = np.zeros(batch.num_rows, np.int64)
            for bucket, begin in features(found, runs, len(gain)):
                own[begin] += gain[bucket]
                number += np.diff(np.searchsorted(begin, found.first))
            total = np.concatenate([[0], np.cumsum(own)])
            weight = total[found.first[1:]] - total[found.first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(number), pa.array(weight), batch.column(2)], names=["doc_id", "n_words", "n_features", "weight", carried])

    kind = rows.schema[carried].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id long, n_words long, n_features long, weight long, {carried} {kind}")


def _noise(seed: str) -> Column:
    """floor(-1000 * ln(-ln((h + 0.5) / 2**32))), h from the SHA-256 of seed:doc_id; a null id hashes as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(docs: DataFrame, target: DataFrame, runs: int, buckets: int, percent: int, least_words: int, seed: str, carried: Column) -> DataFrame:
    """doc_id, n_features, weight, score, rank and _carried of every row; rank is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("_carried"))
    # rows that agree in everything else are told apart by a number, or a text of a third of the rows with one id would be one range
    scored = materialize(_weighed(rows, gain, runs, "_carried").withColumns({"score": F.col("weight") + _noise(seed), "_salt": F.monotonically_increasing_id()}))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("_salt").asc()]
    # where a row lies is written, as a range's rows are counted, numbered and read apart
    placed = materialize(scored.filter(F.col("n_words") >= least_words).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    draw, before, reached = percent * sum(n for _, n in sizes) // 100, 0, []
    for place, n in sizes:
        if before < draw:
            reached.append((place, before))
        before += n
    start = F.broadcast(docs.sparkSession.createDataFrame(reached, "_range int, _before long"))  # a row for each shuffle partition at most
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    counted = placed.join(start, "_range").withColumn("rank", number).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    last = reached[-1][0] if reached else -1
    rest = placed.filter(F.col("_range") > last).unionByName(scored.filter(F.col("n_words") < least_words), allowMissingColumns=True)
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank", "_carried"]
    return counted.select(columns).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(columns))


def resampled(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: str = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    target: texts of the distribution that is wanted. rank runs from 1 over percent % of the rows with least_words words or
    more, by falling score, ties to the smaller doc_id; other rows have none. A null text has no words, weight 0 and a score; a
    null id hashes as '' and comes after others at equal scores; rows that repeat an id have equal noise and are drawn one by
    one; an empty table gives no rows, an empty target counts as uniform; other columns are ignored. A text's arrays are held
    whole, about ten bytes a byte.
    """
    return _ranked(docs, target, runs, buckets, percent, least_words, seed, F.lit(0)).drop("_carried")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that resampled() draws, with all their columns."""
    rows, key = numbered(docs)
    ranks = _ranked(rows, target, **({"runs": 1, "buckets": BUCKETS, "percent": 10, "least_words": 20, "seed": SEED} | options), carried=F.col(key))
    kept = materialize(ranks.filter(F.col("rank").isNotNull()).select(F.col("_carried").alias(key)))
    return rows.join(bounded(kept), key, "left_semi").drop(key)


__all__ = ["bucket_counts", "drawn", "gains", "resampled"]

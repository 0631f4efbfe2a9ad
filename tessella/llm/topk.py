"""Exact top-k search by columnar branch-and-bound.

A task holds its vectors dimension-wise (vertical layout) and adds up inner products block of dimensions by block. By
Cauchy-Schwarz the dimensions not yet seen can add at most the product of both vectors' remaining norms, so candidates
whose partial sum and remaining mass stay below the k-th best sum known are dropped and the columns compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, shared_dir

#: Queries, and bytes of their vectors, that about one pass over the vectors answers; they are what is sent to the tasks.
QUERIES, QUERY_BYTES = 2048, 8 << 20
BLOCK = 8
#: Components of vectors that a task holds in vertical layout at a time.
HELD = 1 << 19


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components floor(scale * x) as longs; vectors that are null, empty or hold a null or non-finite component
    are left out; a component beyond a long is an error."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    return rows.filter(~F.exists("x", bad)).select("vec_id", F.transform("x", lambda c: F.when(F.abs(c * scale) < 2.0**63, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long"))).alias("v"))


def _remaining(columns: np.ndarray, block: int) -> np.ndarray:
    """Norms of the dimensions from each block on (the last row is 0)."""
    squares = (columns.astype(np.float64) ** 2).reshape(len(columns), -1)
    starts = range(0, len(columns), block)
    sums = np.array([squares[i : i + block].sum(0) for i in starts] + [np.zeros(squares.shape[1])])
    return np.sqrt(sums[::-1].cumsum(0)[::-1])


class _Slice:
    """Some vectors of one length in vertical layout, and the bounds' norms, for any number of queries."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int):
        self.ids, self.columns, self.block = ids, np.ascontiguousarray(rows.T), block
        self.floats = self.columns.astype(np.float64)
        self.remaining = _remaining(self.columns, block)
        self.most = float(self.remaining[0].max(initial=0.0))

    def exact(self, query: np.ndarray, live: np.ndarray, most: float) -> np.ndarray:
        """Inner products of some vectors in integers; most bounds them and all their partial sums."""
        if most < 2.0**62:
            return query @ self.columns[:, live]
        whole = [int(x) for x in query.astype(object) @ self.columns[:, live].astype(object)]
        if any(not -(1 << 63) <= x < 1 << 63 for x in whole):
            raise OverflowError("an inner product is beyond a long")
        return np.array(whole, np.int64)

    def best(self, queries: np.ndarray, own: np.ndarray, mass: np.ndarray, k: int, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its k best here, pruned by known, scores that k rows reach already."""
        block = self.block
        # the first block for all queries at once; sums in doubles are off by at most error, so bounds give way by that much
        first = queries[:, :block].astype(np.float64) @ self.floats[:block]
        out = []
        for q in range(len(queries)):
            most = mass[0, q] * self.most
            error = (len(self.columns) + 8) * 2.0**-51 * most
            live = np.flatnonzero(self.ids != own[q])
            partial = first[q][live]
            for b in range(1, mass.shape[0]):
                rest = mass[b, q] * self.remaining[b][live]
                low = partial - rest
                floor = known[q]
                if len(live) > k:
                    floor = max(floor, np.partition(low, len(live) - k)[len(live) - k])
                stay = np.flatnonzero(partial + rest >= floor - 1e-6 * (1 + abs(floor)) - 2 * error)
                live, partial = live[stay], partial[stay]
                at = slice(b * block, (b + 1) * block)
                if b < mass.shape[0] - 1:
                    partial = partial + queries[q, at].astype(np.float64) @ self.floats[at][:, live]
            scores = partial.astype(np.int64) if most < 2.0**52 else self.exact(queries[q], live, most)
            order = np.lexsort((self.ids[live], -scores))[:k]
            out.append((self.ids[live][order], scores[order]))
        return out


def _searched(query_ids: np.ndarray, keys: np.ndarray, queries: np.ndarray, k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, rows_at_once = _remaining(np.ascontiguousarray(queries.T), block), max(64, HELD // queries.shape[1])
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        known = np.full(len(query_ids), -np.inf)
        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            size = np.diff(np.asarray(lists.offsets))
            use = np.flatnonzero(size == queries.shape[1])
            if not len(use):
                continue
            flat = np.asarray(lists.flatten())
            first = np.asarray(lists.offsets)[use] - np.asarray(lists.offsets)[0]
            for i in range(0, len(use), rows_at_once):
                rows = flat[first[i : i + rows_at_once, None] + np.arange(queries.shape[1])]
                part = _Slice(ids[use[i : i + rows_at_once]], rows, block)
                for q, (vec, score) in enumerate(part.best(queries, query_ids, mass, k, known)):
                    v, s = np.concatenate([best[q][0], vec]), np.concatenate([best[q][1], score])
                    order = np.lexsort((v, -s))[:k]
                    best[q] = v[order], s[order]
                    if len(order) == k:
                        known[q] = best[q][1][-1]
        counts = [len(v) for v, _ in best]
        columns = [np.repeat(query_ids, counts), np.repeat(keys, counts), np.concatenate([v for v, _ in best]), np.concatenate([s for _, s in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = BLOCK, at_once: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products, ties to the smaller vec_id. Scores
    are exact at any size; one of a candidate that isn't pruned and is beyond a long is an error.

    Both tables hold vec_id and v (whole numbers); other columns are ignored. A vector isn't its own query's answer and
    meets only queries of its length; a query without partners gives no rows. Candidates that repeat an id are answers of
    their own. Queries that repeat both id and vector are one query, and those that share an id alone are ranked apart. An
    empty table gives no rows. Queries are dealt by hash into blocks of about at_once: a pass over the vectors each, whose
    results are written before the driver reads the next block, so that it holds one.
    """
    spark, kinds = vectors.sparkSession, "query_id long, query long, vec_id long, score long"
    asked = queries.select("vec_id", "v").distinct().withColumns({"size": F.size("v"), "query": F.xxhash64("vec_id", "v")})
    fit = F.greatest(F.lit(1), F.least(F.lit(at_once), F.floor(F.lit(QUERY_BYTES) / (8 * F.col("size")))))
    sizes = asked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", F.ceil(F.col("n") / fit).alias("blocks"))
    dealt = materialize(asked.join(sizes, "size").withColumn("block", F.pmod("query", "blocks")).drop("blocks"), "size", "block")
    passes = sorted((r["size"], r["block"]) for r in dealt.select("size", "block").distinct().collect())
    found, path = spark.createDataFrame([], kinds), shared_dir(spark)
    for size, part in passes:
        rows = dealt.filter((F.col("size") == size) & (F.col("block") == part)).collect()
        ids, keys, data = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "query", "v"))
        found = vectors.select("vec_id", "v").mapInArrow(_searched(ids, keys, data, k, block), kinds)
        if len(passes) > 1:
            found.write.mode("append").parquet(path)
    if len(passes) > 1:
        found = spark.read.schema(kinds).parquet(path)
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

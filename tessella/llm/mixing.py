"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected between 0
(uniform) and 1 (proportional): the smallest one at which no source repeats more often than a limit, or the one at which
the weights' entropy meets a target. The weights are then realised exactly where the rows are: every source is dealt
into blocks of about BLOCK documents by hash, every epoch permutes every block anew, and the last, partial epoch takes
from each block what its token budget allows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded, fresh, materialize, numbered

BLOCK = 1024
SEED = "mix-1"


def counted(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, source, tokens (runs of visible characters of the whole text); null sources count as '', null texts as empty."""
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"), *others)


def exponent(sizes: list[tuple[float, int]], repetition: float | None = None, entropy: float | None = None) -> float:
    """Bisect the exponent for sources of (tokens, number of such sources).

    repetition: the largest number of epochs of any source while every document is read at least once. entropy: nats the
    weights shall have; the proportional entropy if that is more already, the uniform one if it can't be reached.
    """
    sizes = [(n, c) for n, c in sizes if n > 0]
    if (repetition is None) == (entropy is None):
        raise ValueError("give repetition or entropy")
    if not sizes:
        return 1.0
    largest, smallest = max(n for n, _ in sizes), min(n for n, _ in sizes)

    def fits(a: float) -> bool:
        """Whether the exponent is large enough (repetition) or small enough (entropy)."""
        if repetition is not None:
            return (1 - a) * math.log(largest / smallest) <= math.log(repetition)
        total = sum(c * (n / largest) ** a for n, c in sizes)
        return -sum(c * (w := (n / largest) ** a / total) * math.log(w) for n, c in sizes) >= entropy

    low, high = 0.0, 1.0
    if repetition is not None:
        if fits(low):
            return low
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        return high
    if fits(high):
        return high
    if not fits(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def weighted(stats: DataFrame, repetition: float | None = None, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """source, tokens, documents, weight, epochs from stats (source, tokens, documents).

    The driver sees sources only as a histogram of their token counts (1/1024 octave a bin, under 65,536 bins), with the
    true least and largest. epochs = weight * budget / tokens; without a budget it is the least at which every
    document is read once. A source without tokens has weight 0 and is read once if there is no budget, else never.
    """
    bins = stats.filter("tokens > 0").groupBy(F.round(F.log2("tokens") * 1024).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum("tokens").alias("n"), F.min("tokens").alias("low"), F.max("tokens").alias("high"))
    sizes: list[tuple[float, int]] = []
    for r in bins.collect():
        inner = r["c"] - 2
        if inner < 0:
            sizes.append((r["n"], 1))
        else:
            sizes += [(r["low"], 1), (r["high"], 1)] + ([((r["n"] - r["low"] - r["high"]) / inner, inner)] if inner else [])
    alpha = exponent(sizes, repetition, entropy)
    largest = max((n for n, _ in sizes), default=1)
    total = sum(c * (n / largest) ** alpha for n, c in sizes) or 1.0
    whole = float(budget) if budget is not None else largest * total
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / largest, F.lit(alpha)) / total).otherwise(0.0)
    epochs = F.when(F.col("tokens") > 0, F.col("weight") * whole / F.col("tokens")).otherwise(0.0 if budget is not None else 1.0)
    # the largest source's quotient is 1 but for rounding
    return stats.withColumn("weight", weight).withColumn("epochs", F.round(epochs, 9)).withColumn("exponent", F.lit(alpha))


def _digest(*parts):
    return F.sha2(F.concat_ws(":", *(p if not isinstance(p, str) else F.lit(p) for p in parts)), 256)


def mix(docs: DataFrame, repetition: float | None = None, entropy: float | None = None, budget: float | None = None, seed: str = SEED) -> DataFrame:
    """One row per reading of a document (doc_id, text, source): doc_id, source, epoch, block, position, tokens, weight.

    Rows without id are dealt by their place in the table; rows that repeat an id are dealt alike, so that an id of a large part of
    the rows makes a large block, which is sorted on disk; ties in a permutation go by doc_id, then place; an empty table gives no
    rows; other columns are ignored. A document of a partial epoch is read while the tokens before it and half its own
    fit the block's budget.
    """
    rows, key = numbered(docs)
    own = rows.select(F.col(key).alias("_row_key"), "doc_id", "source", "text")
    return _readings(counted(own, "_row_key"), repetition, entropy, budget, seed, "_row_key").select("doc_id", "source", "epoch", "block", "position", "tokens", "weight")


def _readings(counts: DataFrame, repetition: float | None, entropy: float | None, budget: float | None, seed: str, *ties: str) -> DataFrame:
    """mix() of counted rows, with their other columns; ties go by doc_id and then by the columns given."""
    rows = materialize(counts)
    stats = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")))
    plan = weighted(stats, repetition, entropy, budget).select("source", "weight", "epochs", F.ceil(F.col("documents") / BLOCK).alias("blocks"))
    # rows of a null id would all meet in one block; where rows are numbered, they are dealt by number
    own = F.coalesce(F.col("doc_id").cast("string"), *(F.concat(F.lit("row "), F.col(t).cast("string")) for t in ties), F.lit(""))
    # few sources as a rule: Spark sends the plan to the tasks if it is small and splits hot sources of a sort-merge join
    placed = rows.join(plan, "source").withColumn("block", F.pmod(F.conv(F.substring(_digest(seed, own), 1, 12), 16, 10).cast("long"), F.col("blocks")))
    read = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("epochs").cast("int")))).filter(F.col("epoch") < F.col("epochs"))
    order = Window.partitionBy("source", "block", "epoch").orderBy(_digest(seed, own, F.col("epoch").cast("string")), "doc_id", *ties)
    ranked = read.withColumn("position", F.row_number().over(order)).withColumn("_before", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("_block_tokens", F.sum("tokens").over(Window.partitionBy("source", "block", "epoch")))
    share = F.least(F.lit(1.0), F.col("epochs") - F.col("epoch"))
    kept = ranked.filter((share >= 1.0) | (F.col("_before") + F.col("tokens") / 2 <= share * F.col("_block_tokens")))
    return kept.withColumn("weight", F.round("weight", 9))


def mixed_documents(docs: DataFrame, repetition: float | None = None, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """docs with all its columns, each row as often as mix() reads it; rows that repeat an id or have none are read apart.

    Texts stay where they are if few rows are read other than once. Extra columns of any name are kept; null sources count
    as '', null texts as empty ones; an empty table gives no rows.
    """
    rows, key = numbered(docs)
    own = rows.select(F.col(key).alias("_row_key"), "doc_id", "source", "text")
    readings = _readings(counted(own, "_row_key"), repetition, entropy, budget, SEED, "_row_key").groupBy("_row_key").agg(F.count(F.lit(1)).cast("int").alias("_row_times"))
    times, time = fresh(docs, "_row_times"), fresh(docs, "_row_time")
    readings = readings.withColumnsRenamed({"_row_key": key, "_row_times": times})
    if budget is None:  # every row is read once at least
        read = rows.join(bounded(materialize(readings.filter(F.col(times) > 1))), key, "left")
    else:
        read = rows.join(readings, key)
    return read.withColumn(time, F.explode(F.sequence(F.lit(1), F.coalesce(F.col(times), F.lit(1))))).drop(key, times, time)

"""Fusion of ranked channels. A channel row has channel (number), id, rank (from 0) and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_votes(channels: DataFrame) -> DataFrame:
    """An id counts once a channel, by its first row."""
    order = Window.partitionBy("channel", "id").orderBy("rank")
    return channels.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def _merged(votes: DataFrame, limit: int | None) -> DataFrame:
    rows = votes.groupBy("id").agg(F.sum("vote").alias("fused"), F.min(F.struct("channel", "rank")).alias("met"), F.min("rank").alias("best_rank"))
    # equal scores keep the order in which they were met: by channel, then rank
    rows = rows.select("id", F.round("fused", 9).alias("fused"), F.col("met.channel").alias("met_channel"), F.col("met.rank").alias("met_rank"), "best_rank")
    return rows if limit is None else rows.orderBy(F.col("fused").desc(), "met_channel", "met_rank").limit(limit)


def rrf(channels: DataFrame, limit: int | None = None, k: float = 10, base: int = 0, weights: dict[int, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (k + rank + base)."""
    weight = F.lit(1.0)
    for channel, w in (weights or {}).items():
        weight = F.when(F.col("channel") == channel, F.lit(w)).otherwise(weight)
    return _merged(first_votes(channels).withColumn("vote", weight / (F.col("rank") + k + base)), limit)


def dbsf(channels: DataFrame, limit: int | None = None) -> DataFrame:
    """Distribution-based fusion: per channel (score - mean) / (6 sample deviations) + 1/2; 1/2 without deviation."""
    votes = first_votes(channels)
    moments = votes.groupBy("channel").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("spread"))
    joined = votes.join(F.broadcast(moments), "channel")  # a row a channel
    vote = F.when(F.col("spread") > 0, (F.col("score") - F.col("mean")) / F.nullif(6 * F.col("spread"), F.lit(0.0)) + 0.5).otherwise(0.5)
    return _merged(joined.withColumn("vote", vote), limit)


def preserve_heads(fused: DataFrame, limit: int) -> DataFrame:
    """Of a fused list the first limit rows, but every channel's first row stays as long as there are slots for all."""
    order = Window.orderBy(F.col("fused").desc(), "met_channel", "met_rank")
    rows = fused.withColumn("fusion_rank", F.row_number().over(order)).withColumn("leader", F.col("best_rank") == 0)
    heads = F.count_if("leader").over(Window.partitionBy())
    others = F.count_if(~F.col("leader")).over(Window.orderBy("fusion_rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_heads": heads, "_others": others})
    enough = F.col("_heads") <= limit
    kept = rows.filter(F.when(enough, F.col("leader") | (F.col("_others") <= F.lit(limit) - F.col("_heads"))).otherwise(F.col("fusion_rank") <= limit))
    coverage = F.when(enough, "complete").otherwise("insufficient_slots")
    return kept.select("id", "fused", "fusion_rank", F.row_number().over(Window.orderBy("fusion_rank")).alias("selection_rank"), coverage.alias("head_coverage"))

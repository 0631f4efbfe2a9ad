"""Event-time windows over streams, and keeping the newest row of a key from micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """start, event_type, n of a stream or table with ts; rows that are later than late are dropped from streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def distinct_within(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of a key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def coalesced_runs(requests: DataFrame, key: str, at: str, takes: float) -> DataFrame:
    """key, started of a stream of requests (key, at in seconds): the runs of work that takes so long.

    A request to an idle key starts a run; those that come during it ask for one more run at its end, however many they are. A
    key's state is the end of its last run and whether that run is still to begin. Requests of a batch go by time; one
    that comes in a later batch counts as coming no earlier than what the state has seen.
    """

    def run(own: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begun, end = state.get if state.exists else (float("-inf"), float("-inf"))
        out = []
        for t in sorted(x for frame in frames for x in frame[at].dropna().tolist()):
            if t >= end:
                begun, end = t, t + takes
                out.append(t)
            elif t >= begun:  # while the last run is under way
                begun, end = end, end + takes
                out.append(begun)
        state.update((begun, end))
        yield pd.DataFrame({key: [own[0]] * len(out), "started": np.array(out, float)})

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, F.col(at).cast("double").alias(at)).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, started double", "begun double, ends double", "update", "NoTimeout")

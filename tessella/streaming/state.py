"""Jobs and sessions as keyed state over streams, with timers: `transformWithStateInPandas` over the RocksDB state store.

A stream that is replayed in any cut into batches ends where the batch queries end, and one that is stopped goes on from its
checkpoint. State is a few numbers a key, whatever a key's rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_store(spark: SparkSession) -> None:
    """The state store that these operators need; a setting of the session that is read when a stream starts."""
    spark.conf.set(*STORE)


class _Jobs(StatefulProcessor):
    """The first terminal status by order is final, otherwise the last one counts."""

    def __init__(self, terminal: list[str]):
        self.terminal = terminal

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "status string, at long")
        self.final = handle.getValueState("final", "status string, at long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else (None, None)
        final = tuple(self.final.get()) if self.final.exists() else (None, None)
        n = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            n += len(frame)
            known = frame[frame["at"].notna()]
            if known.empty:
                continue
            i = known["at"].idxmax()
            if last[1] is None or known["at"][i] >= last[1]:
                last = known["status"][i], int(known["at"][i])
            done = known[known["status"].isin(self.terminal)]
            if not done.empty:
                i = done["at"].idxmin()
                if final[1] is None or done["at"][i] < final[1]:
                    final = done["status"][i], int(done["at"][i])
        for state, value in ((self.last, last), (self.final, final)):
            if value[1] is not None:
                state.update(value)
        self.count.update((n,))
        yield pd.DataFrame({"job": [key[0]], "status": [final[0] if final[1] is not None else last[0]], "final": [final[1] is not None], "events": [n]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame, terminal: list[str]) -> DataFrame:
    """job, status, final, events of a stream of events (job, status, at: a whole number that orders a job's events): a row for each
    job that a batch changes. A terminal status stays, also where an earlier event comes later; of two terminal ones the
    earlier by order is final. Events without a place in order are counted."""
    rows = events.select("job", "status", F.col("at").cast("long").alias("at"))
    kind = rows.schema["job"].dataType.simpleString()
    return rows.groupBy("job").transformWithStateInPandas(_Jobs(terminal), f"job {kind}, status string, final boolean, events long", "Update", "None")


class _Sessions(StatefulProcessor):
    """A session is open while no more than ttl passes without a row; a timer closes it."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t) for frame in rows for t in frame["ms"])
        first, last, n = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for t in times:
            if last is not None and t - last > self.ttl:
                out.append((first, last, n))
                first, last, n = None, None, 0
            first, last, n = t if first is None else min(first, t), t if last is None else max(last, t), n + 1
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if n:
            self.state.update((first, last, n))
            self.handle.registerTimer(last + self.ttl)
        yield from self._closed(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            out.append(tuple(self.state.get()))
            self.state.clear()
        yield from self._closed(key, out)

    @staticmethod
    def _closed(key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for first, last, n in out:
            yield pd.DataFrame({"session": pd.Series([key[0]], dtype=object), "started": [first], "ended": [last], "events": [n]})

    def close(self) -> None:
        pass


def sessions(events: DataFrame, ttl: str, late: str) -> DataFrame:
    """session, started, ended, events of a stream of rows (session, ts): a row for each session that ends, which is when the
    watermark is ttl past its last row, or a row comes over ttl after it. Rows later than late are dropped."""
    spark = events.sparkSession
    length = int(spark.sql(f"SELECT unix_millis(TIMESTAMP'1970-01-01 00:00:00 UTC' + INTERVAL {ttl}) AS ms").first()["ms"])
    rows = events.select("session", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    kind = rows.schema["session"].dataType.simpleString()
    closed = rows.groupBy("session").transformWithStateInPandas(_Sessions(length), f"session {kind}, started long, ended long, events long", "Append", "EventTime")
    return closed.select("session", F.timestamp_millis("started").alias("started"), F.timestamp_millis("ended").alias("ended"), "events")

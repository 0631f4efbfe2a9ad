"""Replayed streams of jobs and sessions end like batch plans, over a restart from the checkpoint."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators import catalog as C
from tessella.streaming import state as S

BEGIN = datetime(2024, 1, 1)


def replayed(spark, folder, schema, make, mode, stop_after):
    """All rows that a stream over the files of a folder gives, stopped once and restarted."""
    out = []
    for limit in (stop_after, None):
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        writer = make(files).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/check")
        query = writer.foreachBatch(lambda batch, _: out.extend(map(tuple, batch.collect()))).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        if limit:  # the rest of the files come while it is stopped
            for k in range(limit, 6):
                spark.read.schema(schema).parquet(f"{folder}/later/{k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return out


def spread(spark, folder, rows, schema, first):
    for k in range(6):
        part = spark.createDataFrame(rows[k::6] if first is None else rows[k * len(rows) // 6 : (k + 1) * len(rows) // 6], schema).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/in" if k < 3 else f"{folder}/later/{k}")


@pytest.fixture
def store(spark):
    before = spark.conf.get(S.STORE[0])
    S.with_store(spark)
    yield
    spark.conf.set(S.STORE[0], before)


def test_jobs_end_like_the_batch_plan(spark, store, tmp_path):
    r = random.Random(3)
    rows = [(k % 7, r.choice(["view", "click", "error", "purchase"]) if k % 7 else "view", k) for k in range(240)]
    rows += [(8, "error", 5), (8, "purchase", 3), (8, "view", 99), (9, "view", None)]
    r.shuffle(rows)
    schema = "job long, status string, at long"
    spread(spark, tmp_path, rows, schema, None)
    seen = {}
    for job, status, final, n in replayed(spark, tmp_path, schema, lambda s: S.job_states(s, ["error", "purchase"]), "update", 3):
        assert not (job in seen and seen[job][1] and not final)  # a terminal state stays
        seen[job] = status, final, n
    whole = C.job_states(spark.createDataFrame(rows, schema), "job", F.col("status"), F.col("at"), ["error", "purchase"]).collect()
    want = {x["job"]: (x["status"], x["events"]) for x in whole}
    assert {j: (s, n) for j, (s, _, n) in seen.items() if j != 9} == {j: v for j, v in want.items() if j != 9} and seen[9][2] == 1


def test_sessions_expire_and_late_rows_are_dropped(spark, store, tmp_path):
    r = random.Random(6)
    minutes, at = [], 0
    for _ in range(120):
        at += r.choice([1, 2, 3, 9])
        minutes.append((r.choice("ab"), at))
    rows = [(s, BEGIN + timedelta(minutes=m)) for s, m in minutes]
    schema = "session string, ts timestamp"
    # the last batch moves the watermark past everything and holds a row that is far too late
    rows += [("end", BEGIN + timedelta(days=1)), ("a", BEGIN)]
    spread(spark, tmp_path, rows[:-2], schema, 0)
    for k, row in enumerate(rows[-2:]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/later/5")
    got = replayed(spark, tmp_path, schema, lambda f: S.sessions(f, "10 minutes", "1 minute"), "append", 3)
    want = []
    for name in "ab":
        times = [m for s, m in minutes if s == name]
        start = last = times[0]
        n = 1
        for m in times[1:]:
            if m - last > 10:
                want.append((name, start, last, n))
                start, n = m, 0
            last, n = m, n + 1
        want.append((name, start, last, n))
    minute = lambda t: round((t.replace(tzinfo=None) - BEGIN).total_seconds() / 60)
    assert sorted((s, minute(a), minute(b), n) for s, a, b, n in got) == sorted(want)

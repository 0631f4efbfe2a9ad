"""State of catalogs: snapshots merged into a watch list, jobs, staleness along dependencies, conflicts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only where a local session names none."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in columns below the shared checkpoint folder, for rows that are many and read often; it goes by discard(), or
    when the session ends."""
    spark = df.sparkSession
    jvm, path = spark.sparkContext._jvm, f"{_folder(spark)}/{uuid.uuid4().hex}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files of a written() table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(df._written)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def watched(state: DataFrame, seen: DataFrame, complete: bool) -> DataFrame:
    """The watch list after a scan: state (id, size, mtime, missing) and seen (id, size, mtime) give id, size, mtime, changed,
    missing. A file is changed when it is new, its size differs or its time by a second or more. Only a complete scan makes
    files missing; after an incomplete one they keep what was known."""
    s, n = state.alias("s"), seen.withColumn("_seen", F.lit(True)).alias("n")
    here = F.coalesce(F.col("n._seen"), F.lit(False))
    moved = (F.col("s.size") != F.col("n.size")) | (F.abs(F.col("s.mtime") - F.col("n.mtime")) >= 1)
    changed = here & F.coalesce(F.col("s.id").isNull() | moved, F.lit(True))
    missing = F.when(here, F.lit(False)).otherwise(F.lit(True) if complete else F.coalesce("s.missing", F.lit(False)))
    pick = lambda c: F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return s.join(n, F.col("s.id") == F.col("n.id"), "full").select(F.coalesce("s.id", "n.id").alias("id"), pick("size"), pick("mtime"), changed.alias("changed"), missing.alias("missing"))


def stale_closure(units: DataFrame, depends: DataFrame) -> DataFrame:
    """id, needs_recheck of units (id, changed): own change, or a dependency (id, on) that needs it, over any distance; a unit
    that waits on an unknown one needs it too. Each round joins only the units that were found in the round before, so cycles
    end and rounds are as many as the longest chain."""
    known = units.select("id", F.coalesce("changed", F.lit(True)).alias("changed"))
    links = depends.select("id", "on").distinct()
    lost = links.join(known.select(F.col("id").alias("on")), "on", "left_anti").select("id")
    frontier = cut_lineage(known.filter("changed").select("id").union(lost).distinct())
    stale = frontier
    while not frontier.isEmpty():
        reached = links.join(frontier.select(F.col("id").alias("on")), "on", "left_semi").select("id").distinct()
        frontier = cut_lineage(reached.join(stale, "id", "left_anti"))
        stale = cut_lineage(stale.union(frontier))
    return known.select("id").join(stale.withColumn("needs_recheck", F.lit(True)), "id", "left").select("id", F.coalesce("needs_recheck", F.lit(False)).alias("needs_recheck"))


def job_states(events: DataFrame, job: str, status: Column, order: Column, terminal: list[str]) -> DataFrame:
    """job, status, events: the first terminal status in order is final, otherwise the last one counts."""
    rows = events.select(F.col(job), status.alias("_status"), order.alias("_order"))
    final = F.min_by("_status", F.when(F.col("_status").isin(terminal), F.col("_order")))
    return rows.groupBy(job).agg(F.coalesce(final, F.max_by("_status", "_order")).alias("status"), F.count(F.lit(1)).alias("events"))


def retry_class(code: Column) -> Column:
    """Whether a failed call is tried again: rate limits and server errors are, other refusals aren't."""
    return F.when(code.isin(408, 425, 429) | code.between(500, 599), "retry").when(code.between(400, 499), "permanent").otherwise("none")


def in_network(address: Column, network: str) -> Column:
    """Whether a dotted IPv4 address lies in a network such as 10.0.0.0/8; null where it is no address."""
    base, bits = network.split("/")
    number = lambda parts: sum(int(p) << (24 - 8 * i) for i, p in enumerate(parts))
    shift = 32 - int(bits)
    part = [F.split_part(address, F.lit("."), F.lit(i + 1)).try_cast("long") for i in range(4)]
    valid = address.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & (F.greatest(*part) <= 255)
    value = part[0] * (1 << 24) + part[1] * (1 << 16) + part[2] * (1 << 8) + part[3]
    return F.when(valid, F.shiftright(value, shift) == F.lit(number(base.split(".")) >> shift))

"""Helpers shared by the corpus operators: shared storage, heavy keys, skew-safe joins, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds more than 1/HEAVY_SHARE of the rows, or more than HEAVY_ROWS.
HEAVY_SHARE, HEAVY_ROWS = 1024, 100_000
#: Keys with at most this many rows are never heavy (small tables would otherwise call every key heavy).
HEAVY_FLOOR = 64
#: Rows of a few columns that are broadcast at most; a larger side is left to Spark's own choice of a join.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; it goes when the session ends.

    Where that setting is absent, a local session gets a temporary folder and a cluster an error, as its executors share none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tessella/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and every executor can see the files. by: columns
    of few values, each of which gets a folder that is read alone."""
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many low lines after it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(*written: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for df in written:
        spark, path = df.sparkSession, df._written
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique key of each row, and that column's name: rows that repeat an id stay apart in later joins.

    The key is a row's file and place in it, which doesn't change from scan to scan; anything but a table of files is
    written first.
    """
    key, clash = fresh(docs, "_row_key"), {c: fresh(docs, f"{c}_") for c in docs.columns if c.lower() == "_metadata"}
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or clash:
        docs = materialize(docs.withColumnsRenamed(clash))
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.withColumn(key, place).withColumnsRenamed({new: old for old, new in clash.items()}), key


def bounded(df: DataFrame) -> DataFrame:
    """df (written, of a few narrow columns), broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 4 << 20) -> dict[str, str]:
    """Let the session send whole texts to Python in batches of at most so many rows and about so many bytes: a task then holds
    few of them outside its heap. A stage's plan runs after the stage's return, so the setting stays; the settings before
    are returned for who wants them back."""
    before = {}
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        before[key] = spark.conf.get(key)
        now = int(before[key].rstrip("b"))
        spark.conf.set(key, str(min(now, most) if now > 0 else most))
    return before


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() serves texts without multi-byte characters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def heavy_keys(df: DataFrame, keys: str | Sequence[str], rows: int) -> DataFrame:
    """The keys with more than rows/HEAVY_SHARE or HEAVY_ROWS (and HEAVY_FLOOR) rows, written: the keys and _fan, the number of
    salts that deal them out (64 or more, so that a salt has at most HEAVY_ROWS rows). Counts combine map-side.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return heavy_counts(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, rows)


def heavy_counts(counts: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """heavy_keys of keys that are counted already (_n)."""
    limit = min(max(HEAVY_FLOOR, rows // HEAVY_SHARE), HEAVY_ROWS)
    found = counts.filter(F.col("_n") > limit).dropna(subset=list(keys))
    return materialize(found.select(*keys, F.greatest(F.lit(64), F.ceil(F.col("_n") / HEAVY_ROWS)).cast("int").alias("_fan")))


def skew_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], heavy: DataFrame, spread: Column) -> DataFrame:
    """left outer join on keys in which rows of a heavy key are dealt over its salts, taken from spread (a column of left).

    right has one row a key; heavy (heavy_keys of some or all of the keys) has rows that are repeated for every salt.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    own = [c for c in heavy.columns if c != "_fan"]
    hot = bounded(heavy)
    salt = F.when(F.col("_fan").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_fan")).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("_fan").isNotNull(), F.sequence(F.lit(0), F.col("_fan") - 1)).otherwise(F.array(F.lit(0)))
    a = left.join(hot, own, "left").withColumn("_salt", salt).drop("_fan")
    b = right.join(hot, own, "left").withColumn("_salt", F.explode(salts)).drop("_fan")
    return a.join(b, [*keys, "_salt"], "left").drop("_salt")


def below(df: DataFrame, salt: int, rows: int) -> DataFrame:
    """About twice `rows` of df (with _hash, of doc_id and salt), those with the smallest hashes; all if there are few.

    Tasks so send the driver what a sample of `rows` needs and not `rows` each.
    """
    hashed = df.withColumn("_hash", F.xxhash64("doc_id", F.lit(salt)))
    total = df.count()
    if total <= 4 * rows:
        return hashed
    return hashed.filter(F.col("_hash") < int(-(1 << 63) + (1 << 64) * (2 * rows / total)))

"""The register of queries and their SQL, and reading of the given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_KEPT: dict[tuple, str] = {}


def kept(spark: SparkSession, d: str, name: str, build: Callable[[DataFrame, str], str]) -> str:
    """The path of what build(table, path) has written of a given table in this session; it is built anew when one of the
    table's files has another name, size or time."""
    rows = table(spark, d, name)
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(20)"))).first()
    key = (spark.sparkContext.applicationId, f"{d}/{name}", build.__module__, build.__qualname__, *state)
    if key not in _KEPT:
        _KEPT[key] = build(rows, shared(spark))
    return _KEPT[key]


def shared(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only for a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/tessella/{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path

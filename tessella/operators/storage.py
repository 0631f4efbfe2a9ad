"""Changes to stored tables as plans: upserts, replaced and deleted scopes, promotion, payload changes, published generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of all writes to a key the last one in order; its columns stay. One shuffle by key."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return writes.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def scope_conflicts(stored: DataFrame, incoming: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """Incoming keys that are stored under another scope."""
    other = stored.select(key, F.struct(*scope).alias("_scope"))
    return incoming.select(key, F.struct(*scope).alias("_own")).join(other, key).filter(~F.col("_scope").eqNullSafe(F.col("_own"))).select(key)


def replaced_scopes(stored: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """stored with all rows of every scope that incoming names exchanged for incoming's."""
    return stored.join(incoming.select(*scope).distinct(), scope, "left_anti").select(*incoming.columns).unionByName(incoming)


def without(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys), keys, "left_anti")


def promoted(stored: DataFrame, source: str, target: str, column: str = "collection") -> DataFrame:
    """stored with target's rows exchanged for a copy of source's."""
    copy = stored.filter(F.col(column) == source).withColumn(column, F.lit(target))
    return stored.filter(~F.col(column).eqNullSafe(F.lit(target))).unionByName(copy)


def payload_set(payload: Column, changes: dict[str, Column]) -> Column:
    """A map payload with changes: a null value deletes its key."""
    names = F.array(*(F.lit(k) for k in changes))
    kept = F.map_filter(payload, lambda k, v: ~F.array_contains(names, k))
    new = F.map_filter(F.map_from_arrays(names, F.array(*changes.values())), lambda k, v: v.isNotNull())
    return F.map_concat(kept, new)


def publish(rows: DataFrame, root: str, generation: int, expected: int | None = None) -> int:
    """Write rows as a generation below root, then append its manifest row, which makes it current; returns the row count.

    Without its manifest row a generation isn't seen, so a run that dies before it leaves the old one current. A count
    other than expected is refused, and the generation stays unseen.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/generation={generation}")
    count = spark.read.schema(rows.schema).parquet(f"{root}/generation={generation}").count()
    if expected is not None and count != expected:
        raise ValueError(f"generation {generation} has {count} rows, not {expected}")
    spark.range(1).select(F.lit(generation).cast("long").alias("generation"), F.lit(count).cast("long").alias("n_rows"), F.current_timestamp().alias("published")).write.mode("append").parquet(f"{root}/manifest")
    return count


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the newest published generation."""
    newest = spark.read.parquet(f"{root}/manifest").agg(F.max("generation").alias("g")).first()["g"]
    return spark.read.parquet(f"{root}/generation={newest}")

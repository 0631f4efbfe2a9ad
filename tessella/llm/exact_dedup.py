"""Exact dedup by content sort.

Texts are normalised (A-Z lower-cased, null counts as empty) and range-partitioned: Spark samples splitters from the
normalised texts, every task sorts its range externally, and equal texts end up side by side, where whole texts are
compared with their neighbours. A text that holds more than 1/1024 of the rows (or 100,000) is dealt over several ranges
by a salt of its rows' places and its totals are pre-aggregated before they are shuffled, so no range holds a whole hot group,
whatever ids its rows have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import HEAVY_FLOOR, HEAVY_SHARE, ascii_lower, bounded, heavy_keys, materialize, numbered

#: Characters of a text that a splitter holds; ties are split by hash.
BEGIN = 32


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: which id of equal texts stays, "smallest" or "largest". Null texts equal empty ones; a null id yields to any
    other; of repeated rows with one id, and of rows without id where no other has one, exactly one is kept; an empty table
    gives no rows; other columns are ignored.
    """
    rows, key = numbered(docs)
    return _ranked(rows, id_col, text_col, keep, key).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _ranked(docs: DataFrame, id_col: str, text_col: str, keep: str, key: str) -> DataFrame:
    """exact_groups' columns, and each row's key (a column of docs) as _row."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    best, best_by = (F.min, F.min_by) if keep == "smallest" else (F.max, F.max_by)
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(key).alias("_row"))
    # equal normalised texts have equal lower-cased texts, so this 8-byte key finds every hot group
    rows = rows.withColumn("_key", F.xxhash64(F.lower("_text")))
    hot = heavy_keys(rows, "_key", docs.count())
    salt = F.when(F.col("_fan").isNotNull(), F.pmod(F.xxhash64("_row"), F.col("_fan")) + 1).otherwise(F.lit(0)).alias("_salt")
    salted = rows.join(bounded(hot), "_key", "left").select("doc_id", "_row", ascii_lower(F.col("_text")).alias("_norm"), salt)
    totals = materialize(
        rows.join(bounded(hot), "_key")
        .select("doc_id", ascii_lower(F.col("_text")).alias("_norm"), salt)
        .groupBy("_norm")
        # the salt that holds the row which stays, any one if no row has an id
        .agg(best("doc_id").alias("_keep"), F.coalesce(best_by("_salt", "doc_id"), F.min("_salt")).alias("_keep_salt"), F.count(F.lit(1)).alias("_size"))
        .select(F.sha2("_norm", 256).alias("text_sha256"), "_keep", "_keep_salt", "_size")
    )
    # splitters are sampled from a text's beginning and hash, not whole texts, as the driver holds the sample; the ranges
    # keep what both windows need together, so this exchange is the only one
    run = Window.partitionBy("_begin", "_hash", "_norm", "_salt")
    runs = (
        salted.withColumns({"_begin": F.substring("_norm", 1, BEGIN), "_hash": F.xxhash64("_norm")})
        .repartitionByRange("_begin", "_hash", "_salt")
        .withColumn("_rank", F.row_number().over(run.orderBy(order)))
        .withColumn("_run_keep", best("doc_id").over(run))
        .withColumn("_run_size", F.count(F.lit(1)).over(run))
        .select("doc_id", "_row", "_salt", "_rank", "_run_keep", "_run_size", F.sha2("_norm", 256).alias("text_sha256"))
    )
    joined = runs.join(bounded(totals), (runs["text_sha256"] == totals["text_sha256"]) & (runs["_salt"] > 0), "left").drop(totals["text_sha256"])
    keep_id = F.when(F.col("_salt") > 0, F.col("_keep")).otherwise(F.col("_run_keep"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("_size", "_run_size").alias("group_size"),
        ((F.col("_rank") == 1) & ((F.col("_salt") == 0) | F.col("_salt").eqNullSafe(F.col("_keep_salt")))).alias("kept"),
        "text_sha256",
        "_row",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs with all its columns: of the rows with equal texts one stays, also where rows repeat an id or have none.

    Only normalised texts are sorted; the dropped rows' keys then go to where the rows are, if they are few.
    """
    rows, key = numbered(docs)
    gone = _ranked(rows, id_col, text_col, keep, key).filter(~F.col("kept")).select(F.col("_row").alias(key))
    return rows.join(bounded(materialize(gone)), key, "left_anti").drop(key)


__all__ = ["HEAVY_FLOOR", "HEAVY_SHARE", "drop_exact_copies", "exact_groups"]

"""Typed tables in revisions: inferred columns, Parquet files with digests and row counts, pages of a pinned revision.

A table is a folder. ``data/<revision>/`` holds a revision's rows, ranged and sorted by their place; ``files/revision=<n>`` is its
manifest, a row a file with the number of rows before it, so that a page reads only the files that it touches and sorts nothing;
``revisions`` has a row for every revision, which is seen only once that row is there. Nothing is ever changed in place: a
reader that holds a revision goes on reading it while others are written.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a table at most, and whole numbers that a double holds exactly.
COLUMNS, EXACT = 512, 1 << 53
_FLAGS = ("boolean", "long", "double", "string", "other")
_REVISIONS = "revision long, parent long, columns string, n_rows long, n_files long, digest string"


class Refused(ValueError):
    """A table that can't be written or read as asked."""


def cells(rows: DataFrame, text: str = "json") -> DataFrame:
    """key, kind, whole of every cell of rows of JSON objects that isn't null: kind is boolean, long, double, string or other (objects,
    arrays, whole numbers beyond a long), whole a long's value. A row that is no object gives key ''."""
    row = F.try_parse_json(text)
    named = rows.select(F.coalesce(row, F.parse_json(F.lit("null"))).alias("v")).withColumn("object", F.schema_of_variant("v").startswith("OBJECT"))
    parts = named.select(F.explode(F.when(F.col("object"), F.try_variant_get("v", "$", "map<string,variant>")).otherwise(F.map_from_arrays(F.array(F.lit("")), F.array("v")))).alias("key", "value"), "object")
    kind = F.schema_of_variant("value")
    # a fraction such as 12.00 is a decimal without places; a whole number is one only beyond a long
    digits, places = (F.regexp_extract(kind, r"DECIMAL\((\d+),(\d+)\)", k).try_cast("int") for k in (1, 2))
    told = (
        F.when(~F.col("object"), "other").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "long").when(kind == "STRING", "string").when(kind.isin("DOUBLE", "FLOAT"), "double")
        .when((places > 0) | (digits <= 18), "double").otherwise("other")
    )
    return parts.filter(~F.col("object") | (kind != "VOID")).select("key", told.alias("kind"), F.when(kind == "BIGINT", F.try_variant_get("value", "$", "long")).alias("whole"))


def keys(rows: DataFrame, text: str = "json") -> DataFrame:
    """key: all keys of rows of JSON objects, those of nulls too."""
    found = F.map_keys(F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return rows.select(F.explode(found).alias("key")).distinct()


def inferred(rows: DataFrame, numeric: list[str] | None = None, text: str = "json") -> DataFrame:
    """key, type, problem of the columns of rows of JSON objects; counts combine before they are shuffled.

    A column of whole numbers and fractions is double, any other mix is a problem. Columns in numeric are double: their texts are
    read as numbers. One of nulls alone is double if numeric and string otherwise. Whole numbers beyond 2**53 in a double
    column are a problem, as are objects, arrays and empty keys.
    """
    every = keys(rows, text)
    flags = cells(rows, text).groupBy("key").agg(*(F.bool_or(F.col("kind") == k).alias(k) for k in _FLAGS), F.max(F.greatest(F.abs("whole"), F.when(F.col("whole") < -EXACT, F.lit(EXACT + 1)))).alias("largest"))
    number = F.col("key").isin(numeric or [])
    flags = every.join(flags, "key", "full").withColumns({k: F.coalesce(k, F.lit(False)) for k in _FLAGS})
    read = number & F.col("string")
    double = F.col("double") | read | (number & ~F.col("long") & ~F.col("boolean"))
    mixed = (F.col("boolean").cast("int") + (F.col("long") | double).cast("int") + (F.col("string") & ~number).cast("int")) > 1
    kind = F.when(F.col("boolean"), "boolean").when(double, "double").when(F.col("long"), "long").otherwise("string")
    problem = F.when((F.col("key") == "") | (F.col("other") & (F.col("key") == "")), "no object or no name").when(F.col("other") | mixed, "values of several kinds or of none").when((kind == "double") & (F.col("largest") > EXACT), "whole numbers that a double can't hold")
    return flags.select("key", kind.alias("type"), problem.alias("problem"))


def number(text: Column) -> Column:
    """A double from text with blanks, no-break blanks and a comma; null where it is none or isn't finite."""
    value = F.translate(F.regexp_replace(text, "[  ]", ""), ",", ".").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def typed(rows: DataFrame, columns: list[tuple[str, str]], text: str = "json") -> list[Column]:
    """The columns (name, type) of rows of JSON objects; absent keys are null."""
    held = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    out = []
    for name, kind in columns:
        cell = F.try_element_at(held, F.lit(name))
        value = F.try_variant_get(cell, "$", kind)
        if kind == "double":  # texts are read with their commas and blanks
            value = F.when(F.schema_of_variant(cell) == "STRING", number(F.try_variant_get(cell, "$", "string"))).otherwise(value)
        out.append(value.alias(name))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def revisions(spark: SparkSession, root: str) -> DataFrame:
    """revision, parent, columns, n_rows, n_files, digest of every revision that is published."""
    return spark.read.schema(_REVISIONS).parquet(f"{root}/revisions") if _exists(spark, f"{root}/revisions") else spark.createDataFrame([], _REVISIONS)


def newest(spark: SparkSession, root: str) -> int:
    """The number of the newest revision, 0 where there is none."""
    return revisions(spark, root).agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]


def write(rows: DataFrame, root: str, place: list[str], file_rows: int = 1_000_000) -> int:
    """Write typed rows as the table's next revision and return its number; place: the columns that order them, which differ from
    row to row. Files have at most file_rows rows. No rows give an empty revision."""
    spark = rows.sparkSession
    if not 0 < len(rows.columns) <= COLUMNS:
        raise Refused(f"a table has 1 to {COLUMNS} columns")
    parent = newest(spark, root)
    revision, data = parent + 1, f"{root}/data/{parent + 1}"
    if _exists(spark, f"{root}/files/revision={revision}"):
        raise Refused(f"revision {revision} is being written")
    _delete(spark, data)  # of a run that ended before it published
    rows.repartitionByRange(*place).sortWithinPartitions(*place).write.option("compression", "snappy").option("maxRecordsPerFile", file_rows).parquet(data)
    held = spark.read.schema(rows.schema).parquet(data)
    # an ordinal for each file by its first row; files are far fewer than rows
    sizes = held.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct(*place)).alias("_first"))
    digests = _bytes(spark, data).select("file", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))
    order = Window.orderBy("_first")  # of files
    files = sizes.join(digests, "file", "left").withColumns({"ordinal": F.row_number().over(order) - 1, "before": F.coalesce(F.sum("n_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    files.select("ordinal", "file", "n_rows", "before", "size", "digest").coalesce(1).write.parquet(f"{root}/files/revision={revision}")
    manifest = _manifest(spark, root, revision)
    one = manifest.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
    if manifest.filter("digest is null").count():
        raise Refused("a file has no digest")
    one.select(F.lit(revision).cast("long").alias("revision"), F.lit(parent).cast("long").alias("parent"), F.lit(rows.schema.json()).alias("columns"), "n_rows", "n_files", "digest").coalesce(1).write.mode("append").parquet(f"{root}/revisions")
    return revision


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder (write() bounds their rows): file, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("_metadata.file_name").alias("file"), "length", "content")


_FILES = "ordinal int, file string, n_rows long, before long, size long, digest string"


def _manifest(spark: SparkSession, root: str, revision: int) -> DataFrame:
    return spark.read.schema(_FILES).parquet(f"{root}/files/revision={revision}")


def _pinned(spark: SparkSession, root: str, revision: int | None, digest: str | None):
    number_ = revision if revision is not None else newest(spark, root)
    row = revisions(spark, root).filter(F.col("revision") == number_).first()
    if row is None:
        raise Refused(f"there is no revision {number_}")
    if digest is not None and row["digest"] != digest:
        raise Refused("the revision isn't the one that was meant")
    return row


def page(spark: SparkSession, root: str, offset: int, limit: int, revision: int | None = None, digest: str | None = None) -> DataFrame:
    """Rows offset to offset + limit of a revision (the newest), with _row (from 0) and _total; only their files are read.

    digest: what the revision's must be, for readers that go on with a page.
    """
    if offset < 0 or limit < 1:
        raise Refused("offset is at least 0, limit at least 1")
    row = _pinned(spark, root, revision, digest)
    schema = StructType.fromJson(json.loads(row["columns"]))
    touched = _manifest(spark, root, row["revision"]).filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n_rows") > offset)).select("file", "before").collect()  # a page's files
    if not touched:
        return spark.createDataFrame([], schema).select(F.lit(0).cast("long").alias("_row"), "*", F.lit(row["n_rows"]).cast("long").alias("_total"))
    before = F.create_map(*(F.lit(x) for r in touched for x in (r["file"], r["before"])))
    held = spark.read.schema(schema).parquet(*(f"{root}/data/{row['revision']}/{r['file']}" for r in touched))
    at = F.element_at(before, F.col("_metadata.file_name")) + F.col("_metadata.row_index")
    return held.select(at.alias("_row"), "*", F.lit(row["n_rows"]).cast("long").alias("_total")).filter(F.col("_row").between(offset, offset + limit - 1))


def damaged(spark: SparkSession, root: str, revision: int | None = None) -> DataFrame:
    """file, problem of a revision's files whose bytes aren't what its manifest says, or that are gone."""
    row = _pinned(spark, root, revision, None)
    held = _bytes(spark, f"{root}/data/{row['revision']}").select("file", F.sha2("content", 256).alias("now"))
    both = _manifest(spark, root, row["revision"]).join(held, "file", "left")
    return both.filter(~F.col("now").eqNullSafe(F.col("digest"))).select("file", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def write_json(rows: DataFrame, root: str, place: list[str], numeric: list[str] | None = None, text: str = "json", file_rows: int = 1_000_000) -> int | None:
    """Write rows of JSON objects (text, and the columns of place) as a table of inferred columns in order of their names; returns
    its revision. Tables without rows aren't written (None); those with a problem are refused, which names the first."""
    found = sorted(map(tuple, inferred(rows, numeric, text).limit(COLUMNS + 1).collect()))
    if any(problem for _, _, problem in found):
        raise Refused(next(f"{key}: {problem}" for key, _, problem in found if problem))
    if not found:
        return None
    if len(found) > COLUMNS:
        raise Refused(f"more than {COLUMNS} columns")
    values = rows.select(*(F.col(c).alias(f"_place_{c}") for c in place), *typed(rows, [(k, t) for k, t, _ in found], text))
    return write(values, root, [f"_place_{c}" for c in place], file_rows)

"""Readers of file trees: listings, fingerprints, strict delimited tables, record texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import visible_document


def scan_files(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path, name, length, modified of every visible file below root, but in folders named in skip. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    found = found.withColumn("name", F.element_at(parts, -1))
    if skip:
        found = found.filter(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*(F.lit(s) for s in skip))))
    return found.filter(visible_document(F.col("name"))).select("path", "name", "length", "modified")


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified, sha256 of every file below root; a file is read whole by one task (2 GB at most)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def decoded(content: Column) -> Column:
    """Text of file bytes by their byte order mark, else UTF-8; null where control characters show a binary file."""
    head = F.hex(F.substring(content, 1, 3))
    skip = lambda n, name: F.decode(F.substring(content, n + 1, 2**31 - 1), name)
    text = F.when(head == "EFBBBF", skip(3, "UTF-8")).when(head.startswith("FFFE"), skip(2, "UTF-16LE")).when(head.startswith("FEFF"), skip(2, "UTF-16BE")).otherwise(F.try_validate_utf8(content.cast("string")))
    return F.when(~text.rlike(r"[\x00-\x08\x0e-\x1f]"), text)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", ragged: bool = False) -> DataFrame:
    """A delimited table with a header line and quoted line ends; rows of another width end the query unless ragged."""
    reader = spark.read.schema(schema).option("header", "true").option("sep", sep).option("multiLine", "true").option("escape", '"')
    return reader.option("mode", "PERMISSIVE" if ragged else "FAILFAST").csv(path)


def record_text(json: Column, first: tuple[str, ...] = ()) -> Column:
    """A JSON object as lines of "key: value": keys of first in their order, then the others by name; null for other JSON."""
    fields = F.from_json(json, "map<string,string>", {"allowNonNumericNumbers": "true"})
    lead = F.array(*(F.lit(k) for k in first)).cast("array<string>")
    keys = F.concat(F.filter(lead, lambda k: F.map_contains_key(fields, k)), F.array_except(F.array_sort(F.map_keys(fields)), lead))
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.coalesce(F.element_at(fields, k), F.lit("null")))), "\n")

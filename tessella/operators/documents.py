"""Nested documents walked level by level into elements, relations and properties."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.catalog import cut_lineage

#: Levels of a document at most.
DEPTH = 64


class Walked(NamedTuple):
    """elements: doc_id, path, owner (the element around, null for the outermost), id, type; properties: doc_id, owner, key, value."""

    elements: DataFrame
    properties: DataFrame


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def _scalar(value: Column) -> Column:
    return ~(_is(value, "OBJECT") | _is(value, "ARRAY"))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def walk(docs: DataFrame, depth: int = DEPTH, text: str = "json") -> Walked:
    """Elements and properties of documents (doc_id and a text of JSON), a round a level, each of which is written once.

    Every object is an element; its path is $ and the keys and [places] down to it. What isn't an object or an array is a property
    of the innermost object around it, its key the keys and places below that. A relation is an element's owner. Texts that are
    no JSON, and documents that are a scalar, give nothing; a null property has a null value; deeper documents than depth are
    an error.
    """
    root = docs.select("doc_id", F.lit("$").alias("path"), F.lit(None).cast("string").alias("owner"), F.lit("").alias("key"), F.try_parse_json(text).alias("value"))
    level = cut_lineage(root.filter(F.col("value").isNotNull() & ~_scalar(F.col("value"))))
    elements, properties = [], []
    for k in range(depth + 1):
        if k and level.isEmpty():
            break
        if k == depth:
            raise ValueError(f"a document has over {depth} levels")
        objects, arrays = level.filter(_is(F.col("value"), "OBJECT")), level.filter(_is(F.col("value"), "ARRAY"))
        own = lambda name: F.when(_scalar(F.try_variant_get("value", f"$.{name}", "variant")), F.try_variant_get("value", f"$.{name}", "string"))
        elements.append(objects.select("doc_id", "path", "owner", own("id").alias("id"), own("type").alias("type")))
        members = objects.select("doc_id", F.col("path").alias("owner"), "path", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("key", "value"))
        members = members.select("doc_id", F.concat_ws(".", "path", "key").alias("path"), "owner", "key", "value")
        items = arrays.select("doc_id", "path", "owner", "key", F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("_at", "value"))
        place = F.concat(F.lit("["), F.col("_at"), F.lit("]"))
        items = items.select("doc_id", F.concat("path", place).alias("path"), "owner", F.concat("key", place).alias("key"), "value")
        below = members.unionByName(items)
        # scalars of an outermost array have no element around
        properties.append(below.filter(_scalar(F.col("value")) & F.col("owner").isNotNull()).select("doc_id", "owner", "key", _text(F.col("value")).alias("value")))
        level = cut_lineage(below.filter(~_scalar(F.col("value"))))
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    return Walked(union(elements), union(properties))

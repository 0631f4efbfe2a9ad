"""A store's audit finds recipes that were shortened, reordered, given a wrong length or root, or lost."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import token_store
from tessella.llm.common import shared_dir

DAMAGED = 7


@pytest.fixture(scope="module")
def store(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(3000))) for i in range(12)] + [(12, None)]
    return token_store.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shared_dir(spark))


def audited(spark, store, change):
    """Verdicts of a copy of the store with changed recipes."""
    import os
    import shutil

    path = shared_dir(spark)
    shutil.copytree(store, path, ignore=lambda folder, names: ["recipes"] if os.path.samefile(folder, store) else [])
    change(spark.read.parquet(f"{store}/recipes")).write.parquet(f"{path}/recipes")
    return {r["doc_id"]: r["verified"] for r in token_store.audit(spark, path).collect()}


def damaged(column, value):
    return lambda recipes: recipes.withColumn(column, F.when(F.col("doc_id") == DAMAGED, value).otherwise(F.col(column)))


def test_audit_finds_damaged_recipes(spark, store):
    whole = {i: True for i in range(13)}
    assert audited(spark, store, lambda recipes: recipes) == whole
    one = whole | {DAMAGED: False}
    assert audited(spark, store, damaged("chunks", F.slice("chunks", 1, F.size("chunks") - 1))) == one
    assert audited(spark, store, damaged("chunks", F.reverse("chunks"))) == one
    assert audited(spark, store, damaged("chunks", F.slice("chunks", 1, 0))) == one
    longer = F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), (c["n"] + 1).alias("n")))
    assert audited(spark, store, damaged("chunks", longer)) == one
    for column in ("n_tokens", "start"):
        assert audited(spark, store, damaged(column, F.col(column) + 1))[DAMAGED] is False
    assert audited(spark, store, damaged("root", F.sha2("root", 256)))[DAMAGED] is False
    missing = audited(spark, store, lambda recipes: recipes.filter(F.col("doc_id") != DAMAGED))
    assert missing[DAMAGED] is False and set(missing) == set(whole)


def test_part_tree_by_subtrees_is_the_whole_tree(spark):
    import hashlib

    n = 2500
    rows = spark.range(n).select(F.lit(0).alias("part"), F.col("id").alias("ordinal"), F.col("id").alias("doc_id"), F.col("id").alias("start"), F.lit(1).alias("n_tokens"), F.lit("x").alias("root"))
    leaves = [hashlib.sha256(f"{i}:{i}:1:x".encode()).digest() for i in range(n)]
    assert [r["root"] for r in token_store.part_roots(rows).collect()] == [token_store.merkle(leaves).hex()]

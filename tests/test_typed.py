"""Inferred columns and revisioned tables: kinds, refusals, pages of a pinned revision, damage."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import typed as T
from tessella.plans.base import shared


def frame(spark, rows):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "pos long, json string").repartition(3)


def kinds(spark, rows, numeric=()):
    return {r["key"]: (r["type"], r["problem"]) for r in T.inferred(frame(spark, rows), list(numeric)).collect()}


def test_kinds_of_columns(spark):
    rows = ['{"a": 1, "b": 2.5, "c": "x", "d": true, "e": null, "f": 1, "h": 12.00, "q": "1 000,5", "n": null}', '{"a": -7, "b": 3, "f": 1.0e3, "g\'h": 4, "q": null}', "{}"]
    assert kinds(spark, rows, ["q", "n"]) == {k: (t, None) for k, t in {"a": "long", "b": "double", "c": "string", "d": "boolean", "e": "string", "f": "double", "h": "double", "g'h": "long", "q": "double", "n": "double"}.items()}


@pytest.mark.parametrize("rows", [['{"a": 1}', '{"a": "x"}'], ['{"a": true}', '{"a": 1}'], ['{"a": [1]}'], ['{"a": {"b": 1}}'], ["[1]"], ["not json"], ['{"": 1}'], ['{"a": 9007199254740993, "b": 1}', '{"a": 0.5}'], ['{"a": 99999999999999999999}']])
def test_refused_columns(spark, rows):
    with pytest.raises(T.Refused):
        T.write_json(frame(spark, rows), shared(spark), ["pos"])


def test_values_come_back_in_order(spark):
    root = shared(spark)
    rows = ['{"a": 1, "q": "1 000,5", "d": false}', '{"q": 2, "z": "Ж"}', '{"a": null, "q": "x"}', '{"a": 9007199254740993}']
    assert T.write_json(frame(spark, rows), root, ["pos"], ["q"], file_rows=2) == 1
    got = [(r["_row"], r["a"], r["d"], r["q"], r["z"], r["_total"]) for r in T.page(spark, root, 0, 10).orderBy("_row").collect()]
    assert got == [(0, 1, False, 1000.5, None, 4), (1, None, None, 2.0, "Ж", 4), (2, None, None, None, None, 4), (3, 9007199254740993, None, None, None, 4)]
    assert T.write_json(frame(spark, rows).limit(0), root, ["pos"]) is None and T.newest(spark, root) == 1


def test_pages_of_a_pinned_revision(spark):
    root = shared(spark)
    assert T.newest(spark, root) == 0
    first = T.write(spark.range(1000).withColumn("v", F.col("id") * 2), root, ["id"], file_rows=100)
    second = T.write(spark.range(500, 700).withColumn("v", F.lit("text")), root, ["id"])
    assert (first, second) == (1, 2)
    rows = T.page(spark, root, 95, 10, revision=1)
    assert [(r["_row"], r["id"], r["v"], r["_total"]) for r in rows.orderBy("_row").collect()] == [(k, k, 2 * k, 1000) for k in range(95, 105)]
    assert len(rows.inputFiles()) <= 3
    assert [r["id"] for r in T.page(spark, root, 198, 10).orderBy("_row").collect()] == [698, 699]
    assert T.page(spark, root, 2000, 10).count() == 0
    digest = T.revisions(spark, root).filter("revision = 1").first()["digest"]
    assert T.page(spark, root, 0, 1, revision=1, digest=digest).count() == 1
    for bad in (lambda: T.page(spark, root, 0, 1, revision=2, digest=digest), lambda: T.page(spark, root, 0, 1, revision=9), lambda: T.page(spark, root, -1, 1)):
        with pytest.raises(T.Refused):
            bad()
    again = T.write(spark.range(1000).withColumn("v", F.col("id") * 2).limit(0), root, ["id"])
    assert again == 3 and T.page(spark, root, 0, 5).count() == 0


def test_damage_and_unpublished_revisions(spark):
    root = shared(spark)
    T.write(spark.range(100), root, ["id"], file_rows=20)
    assert T.damaged(spark, root).count() == 0
    local = root.removeprefix("file:")
    a, b = sorted(glob.glob(f"{local}/data/1/*.parquet"))[:2]
    data = bytearray(open(a, "rb").read())
    data[len(data) // 2] ^= 1
    open(a, "wb").write(bytes(data))
    os.rename(b, b + ".gone")
    for side in glob.glob(f"{local}/data/1/.*.crc"):  # the local file system's own checksums
        os.remove(side)
    assert {r["problem"] for r in T.damaged(spark, root).collect()} == {"changed", "missing"}
    # data of a run that ended before it was published isn't seen and is replaced
    spark.range(5).write.parquet(f"{root}/data/2")
    assert T.newest(spark, root) == 1 and T.write(spark.range(7), root, ["id"]) == 2
    assert T.page(spark, root, 0, 100).count() == 7

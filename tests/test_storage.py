"""Stored-table changes, file readers, text functions and outlines on small rows, and a stream of requests."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import storage as S
from tessella.operators import structure as D
from tessella.sources import files
from tessella.streaming import events


def column(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_upsert_and_scopes(spark):
    writes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "id int, seq int, v string")
    assert {(r["id"], r["v"]) for r in S.upserted(writes, ["id"], ["seq"]).collect()} == {(1, "b"), (2, None)}
    stored = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, scope string")
    new = spark.createDataFrame([(4, "x"), (3, "x")], "id int, scope string")
    assert {tuple(r) for r in S.replaced_scopes(stored, new, ["scope"]).collect()} == {(3, "y"), (4, "x"), (3, "x")}
    assert [r["id"] for r in S.scope_conflicts(stored, new, "id", ["scope"]).collect()] == [3]
    assert S.replaced_scopes(stored, new.limit(0), ["scope"]).count() == 3


def test_promotion_replaces_the_target(spark):
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "collection string, id int")
    assert sorted((r["collection"] or "", r["id"]) for r in S.promoted(stored, "a", "b").collect()) == [("", 4), ("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_generations(spark, tmp_path):
    root = str(tmp_path / "store")
    assert S.publish(spark.range(5), root, 1) == 5
    with pytest.raises(ValueError):
        S.publish(spark.range(3), root, 2, expected=4)
    assert S.current(spark, root).count() == 5
    S.publish(spark.range(3), root, 2, expected=3)
    assert S.current(spark, root).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a" / "skip").mkdir(parents=True)
    for name, data in (("a/one.txt", b"x"), ("a/~$one.txt", b"x"), ("a/skip/two.txt", b"yy"), ("b.csv", b'k,v\n1,"a\nb"\n'), ("bad.csv", b"k,v\n1,2,3\n")):
        (tmp_path / name).write_bytes(data)
    root = str(tmp_path)
    assert {r["name"] for r in files.scan_files(spark, root, ("skip",)).collect()} == {"one.txt", "b.csv", "bad.csv"}
    assert {r["length"] for r in files.fingerprints(spark, f"{root}/a").collect()} == {1, 2}
    assert [tuple(r) for r in files.read_delimited(spark, f"{root}/b.csv", "k int, v string").collect()] == [(1, "a\nb")]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_delimited(spark, f"{root}/bad.csv", "k int, v string").collect()


def test_decoded(spark):
    data = [b"\xef\xbb\xbfab", "é".encode("utf-16"), b"\xfe\xff\x00a", b"plain", b"a\x00b", b"\xff\xfa"]
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(data)], "i int, b binary")
    assert [r["t"] for r in rows.select("i", files.decoded(F.col("b")).alias("t")).orderBy("i").collect()] == ["ab", "é", "a", "plain", None, None]


def test_record_text(spark):
    assert column(spark, lambda t: files.record_text(t, ("name",)), ['{"b":1,"name":"n","a":null}', "{}", "nope", None]) == ["name: n\na: null\nb: 1", "", None, None]


def test_citations_and_addresses(spark):
    texts = ["see [2], [5-3] and [1, 9]", "`[4]` ```\n[7]\n``` [x]", "", None]
    assert column(spark, X.citations, texts) == [[1, 2, 3, 4, 5, 9], [], [], None]
    assert column(spark, X.addresses, ["B@x.org, a@x.org b@X.org", "a@b", None]) == [["a@x.org", "b@x.org"], [], None]


def test_binary_garbage(spark):
    line = "A/" * 40
    assert column(spark, X.binary_garbage, [f"{line}\n{line}", "word " * 40, line, "ж" * 100, "short", None]) == [True, False, False, False, False, False]


def test_heading_paths(spark):
    parts = [(1, 0, 9, "lead"), (1, 1, 1, "A"), (1, 2, 2, "a"), (1, 3, 9, "p"), (1, 4, 3, "x"), (1, 5, 2, "b"), (1, 6, 1, "B"), (1, 7, 3, "deep"), (2, 0, 2, "only")]
    rows = D.heading_paths(spark.createDataFrame(parts, "doc_id int, ord int, level int, title string"), 3).orderBy("doc_id", "ord").collect()
    assert [r["path"] for r in rows] == ["", "A", "A > a", "A > a", "A > a > x", "A > b", "B", "B > deep", "only"]


def test_coalesced_runs_stream(spark, tmp_path):
    ask = lambda rows: spark.createDataFrame(rows, "user string, at double")
    # 0 starts a run to 10; 3 and 4 ask for one more, from 10 to 20; 12 for another; 45 starts anew
    ask([("a", 0.0), ("a", 3.0), ("a", 4.0), ("b", 1.0)]).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("user string, at double").parquet(f"{tmp_path}/in")
    seen = []
    run = lambda: events.coalesced_runs(source(), "user", "at", 10.0).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination(120)
    run()
    ask([("a", 12.0), ("a", 45.0)]).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(seen) == [("a", 0.0), ("a", 10.0), ("a", 20.0), ("a", 45.0), ("b", 1.0)]

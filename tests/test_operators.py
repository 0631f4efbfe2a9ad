"""Operators that SQL can't express, and small hand-made cases."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import catalog, chunking, fusion, tables
from tessella.streaming import events


def test_windows_cover_the_text(spark):
    text = "One sentence here. Another one\nA line. " * 40
    cut = list(chunking.windows(text, 100, 20))
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(b[0] <= a[1] and b[0] > a[0] and a[1] - a[0] <= 100 for a, b in zip(cut, cut[1:]))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    got = chunking.chunk_pages(docs, 100, 20).collect()
    assert {r["doc_id"] for r in got} == {1, 4} and all(text[r["start"] :].startswith(r["chunk"]) for r in got if r["doc_id"] == 1)
    with pytest.raises(ValueError):
        chunking.chunk_pages(docs, 10, 10)


def test_text_functions(spark):
    row = spark.createDataFrame([("Straße Ёлка AXIS‑P1375 17.25", "AB", "Re: FW: Hello  there", "Doc (2).PDF", "книгами")], "a string, b string, c string, d string, e string")
    got = row.select(X.tokens(F.col("a")), X.column_number(F.col("b")), X.subject_key(F.col("c")), X.name_family(F.col("d")), X.light_stem(F.col("e")), X.column_letters(F.lit(28))).first()
    assert got[0] == ["strasse", "елка", "axis-p1375", "17.25"]
    assert tuple(got)[1:] == (28, "hello there", "doc.pdf", "книгам", "AB")


def test_sanitize(spark):
    row = spark.createDataFrame([("a data:image/png;base64," + "A" * 200 + "== b" + "     c\n\n\n\n\n\nd\x07e " + "Zz9+" * 80,)], "t string")
    assert row.select(X.sanitize(F.col("t"))).first()[0] == "a  b  c\n\n\nd e "


def test_exact_decimals_and_fusion(spark):
    rows = spark.createDataFrame([("0,1",)] * 600 + [("1 000.5",), ("x",), (None,)], "v string")
    got = tables.exact_sum(rows, F.col("v")).first()
    assert (str(got["exact_total"]).rstrip("0"), got["counted"], got["missing"], got["complete"]) == ("1060.5", 601, 2, False)
    one = spark.createDataFrame([(0, 1, 0, 5.0), (0, 1, 1, 4.0), (1, 2, 0, 1.0)], "channel int, id long, rank int, score double")
    assert [(r["id"], r["fused"]) for r in fusion.dbsf(one, 5).collect()] == [(1, 0.5), (2, 0.5)]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    with tempfile.TemporaryDirectory() as folder:
        spark.read.parquet(path).write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/in")
        run = events.tumbling(stream, "1 day", "1 day").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
        run.awaitTermination(60)
        assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, events.tumbling(spark.read.parquet(path), "1 day", "1 day").collect()))


def test_sections_and_fitting_chunks_join_to_the_text():
    text = "intro\n# One\nbody\n```\n# no heading\n```\n## Two\nend " + "word " * 300
    parts = list(chunking.sections(text))
    assert [h for h, _, _ in parts] == ["", "One", "Two"] and "".join(text[a:b] for _, a, b in parts) == text
    cut = list(chunking.fitting(text, 50))
    assert "".join(text[a:b] for a, b in cut) == text and all(len(text[a:b].split()) <= 50 for a, b in cut)
    assert list(chunking.fitting("", 5)) == [] and len(list(chunking.fitting("x" * 1000, 5))) >= 1


def test_watch_and_staleness(spark):
    state = spark.createDataFrame([(1, 5, 10.0, False), (2, 5, 10.0, False)], "id long, size long, mtime double, missing boolean")
    seen = spark.createDataFrame([(1, 5, 10.5)], "id long, size long, mtime double")
    got = {r["id"]: (r["changed"], r["missing"]) for r in catalog.watched(state, seen, complete=False).collect()}
    assert got == {1: (False, False), 2: (False, False)}
    assert catalog.watched(state, seen, complete=True).filter("missing").first()["id"] == 2
    units = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], "id long, changed boolean")
    links = spark.createDataFrame([(2, 1), (3, 2), (2, 3), (4, 4)], "id long, on long")
    assert {r["id"] for r in catalog.stale_closure(units, links).filter("needs_recheck").collect()} == {1, 2, 3}

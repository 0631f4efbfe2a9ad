"""Chunk windows, stems, Unicode forms, numbers, short passages and stored postings against plain Python."""

import math
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import unicode as U
from tessella.operators import chunking, postings
from tessella.plans import registry
from tessella.plans.base import shared


def pages_by_hand(text, size, overlap):
    text, out, start = text.strip(), [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            window = text[start:end]
            at = max(window.rfind("\n"), window.rfind(". "))
            if at >= 0 and start + at > start + size // 2:
                end = start + at + (1 if window[at] == "\n" else 2)
        if chunk := text[start:end].strip():
            out.append(chunk)
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def test_chunk_pages_equal_a_plain_walk(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "bc", " ", ". ", "\n", "\n\n", "é"]) for _ in range(r.randint(0, 400))) for _ in range(60)] + [None, "", "  \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in sorted(chunking.chunk_pages(docs, 60, 12).collect(), key=lambda x: (x["doc_id"], x["ord"])):
        assert texts[x["doc_id"]][x["start"] :].startswith(x["chunk"])
        got.setdefault(x["doc_id"], []).append(x["chunk"])
    assert got == {i: c for i, t in enumerate(texts) if t and (c := pages_by_hand(t, 60, 12))}


def test_text_rules(spark):
    words = ["книгами", "новейшая", "стол", "окно", "дома", "делают", "axis", "р2д2", "ёлками", "её"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.light_stem(F.col("w"))).collect()]
    by_hand = []
    for w in words:
        stem = w
        if len(w) >= 4 and re.fullmatch("[а-яё]+", w):
            stem = next((w[: -len(e)] for e in X.LIGHT_ENDINGS if w.endswith(e) and len(w) - len(e) >= 4), w)
        by_hand.append(stem)
    assert got == by_hand and got[0] == "книгам"
    forms = ["ﬁ", "Ｆｕｌｌ", "é", "Straße", "İ", "ẞ", None, "①", "한"]
    row = spark.createDataFrame([(f,) for f in forms], "t string").select(U.nfkc("t"), U.full_casefold("t")).collect()
    assert [tuple(r) for r in row] == [(None, None) if f is None else (n := unicodedata.normalize("NFKC", f), n.casefold()) for f in forms]
    numbers = {"1_000": 1000, " -7 ": -7, "+0": 0, "1__0": None, "_1": None, "1_": None, "": None, "9" * 40: 2**63 - 1, "-" + "9" * 20: -(2**63), "9223372036854775807": 2**63 - 1, "-9223372036854775808": -(2**63), "000": 0, "x": None, None: None}
    got = spark.createDataFrame([(n,) for n in numbers], "t string").select("t", X.saturated_integer(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == numbers
    assert set(spark.createDataFrame([("abca",)], "t string").select(X.stretches(F.col("t"), 2)).first()[0]) == {"", "a", "b", "c", "ab", "bc", "ca"}


def test_short_passages_are_found(spark, tmp_path):
    from tessella.plans.corpus import anchor_recall

    docs = [(1, "one two three four five six seven"), (2, "x"), (3, ""), (4, "two three"), (5, "a two thr b")]
    passages = [(1, "two three"), (2, "x"), (3, "two thr"), (4, "six"), (5, "one two three four five six"), (6, "zz")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["item_id"], r["doc_id"]) for r in anchor_recall(spark, str(tmp_path)).collect()}
    assert got == {(i, d) for i, p in passages for d, t in docs if p in t}


def bm25_by_hand(texts, terms):
    words = {i: re.findall("[a-z]+", t or "") for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    out = Counter()
    for term in set(terms):
        df = sum(term in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(term):
                out[i] += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return {i: round(s, 6) for i, s in out.items()}


def test_stored_postings_follow_changes(spark):
    r = random.Random(2)
    vocabulary = ["red", "steel", "pipe", "a", "b", "c"]
    texts = {i: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))) for i in range(40)} | {40: None, 41: ""}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = lambda path: {x["doc"]: round(x["score"], 6) for x in postings.scores(spark, path, ["red", "pipe", "red", "none"]).collect()}
    path = postings.build(frame(texts), shared(spark))
    assert found(path) == bm25_by_hand(texts, ["red", "pipe"])
    new = {3: "red red", 50: "pipe " * 9, 51: None}
    after = {i: t for i, t in texts.items() if i not in (1, 2, 40)} | new
    path = postings.update(spark, path, spark.createDataFrame([(1,), (2,), (40,), (99,)], "doc long"), frame(new), shared(spark))
    assert found(path) == bm25_by_hand(after, ["red", "pipe"])
    # a second delta on the first: 3 comes back as another text, 50 goes, 1 returns
    last = {i: t for i, t in after.items() if i != 50} | {3: "pipe a", 1: "red"}
    before, path = path, postings.update(spark, path, spark.createDataFrame([(50,)], "doc long"), frame({3: "pipe a", 1: "red"}), shared(spark), expected=len(last))
    assert found(path) == bm25_by_hand(last, ["red", "pipe"]) and found(before) == bm25_by_hand(after, ["red", "pipe"])
    once = postings.compact(spark, path, shared(spark))
    assert found(once) == found(path) and {r["doc"] for r in postings.read(spark, once)[1].collect()} == set(last)
    with pytest.raises(ValueError, match="documents"):
        postings.update(spark, path, spark.createDataFrame([(50,)], "doc long"), frame({}), shared(spark), expected=1)
    empty = postings.build(frame(texts).limit(0), shared(spark))
    assert found(empty) == {}


def test_postings_are_counted_without_a_shuffle(spark):
    texts = ["Red pipe red", None, "", "pipe 17.25 pipe pipe"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = postings.counted(docs.localCheckpoint())
    assert sorted(map(tuple, rows.collect())) == [("17.25", 3, 1, 4), ("pipe", 0, 1, 3), ("pipe", 3, 3, 4), ("red", 0, 2, 3)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_postings_are_sorted_in_bounded_runs(spark, monkeypatch):
    """No task sorts all of its postings: runs of RUN words are sorted, whatever the batches; counts stay the same."""
    lists = [pa.array(x, pa.list_(pa.string())) for x in ([["b", "a", "b"], [], ["c"] * 9, ["a", "b"]], [["d", "a"], ["a"]], [])]
    at, batches = 0, []
    for x in lists:
        batches.append(pa.RecordBatch.from_arrays([pa.array(range(at, at + len(x)), pa.int64()), x], names=["doc", "words"]))
        at += len(x)
    want = sorted((t, k, v.count(t), len(v)) for k, v in enumerate(w for x in lists for w in x.to_pylist()) for t in set(v))
    for run in (1, 4, 5, 1 << 20):
        monkeypatch.setattr(postings, "RUN", run)
        runs = [list(zip(*(c.to_pylist() for c in b.columns))) for b in postings._counts(iter(batches))]
        assert all(r == sorted(r) for r in runs) and sorted(row for r in runs for row in r) == want
        assert all(sum(row[2] for row in r) <= max(run, 9) for r in runs)


def test_frequencies_by_delta_shuffle_terms_only(spark, tmp_path):
    spark.createDataFrame([(k, f"a b{k}") for k in range(1, 7)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["postings_update"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {r["term"]: r["df"] for r in found.collect()} == {"a": 5, "b1": 1, "b2": 1, "b3": 1, "b4": 1, "b6": 1}

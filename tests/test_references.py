"""Mentions, named files, reply chains with missing parents and cycles, and answers that must fit."""

import random

from pyspark.sql import functions as F

from tessella.operators import references as N


def test_mentions(spark):
    rows = [(1, "see 17.25-A1 and 99"), (2, "x 17.25-A1, 17.25-A1; 555-2373"), (3, "555-2373 17.25-a1"), (4, None), (5, "17.25-A1x 117.25-A1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = docs.select("doc_id", F.get(N.numbers(F.col("text")), F.lit(0)).alias("number"))
    assert [r["number"] for r in named.orderBy("doc_id").collect()] == ["17.25-A1", "17.25-A1", "555-2373", None, "17.25-A1x"]
    assert sorted(map(tuple, N.reference_edges(named, docs).collect())) == [(2, 1, 1), (2, 3, 1)]


def test_named_files(spark):
    files = [(1, "Plans/Floor 2/001_Содержание.PDF"), (2, "Other/Floor 2/001_Содержание.pdf"), (3, "Plans/long_report_name.docx"), (4, "a.b"), (5, "Plans/01_Содержание.pdf"), (6, None), (7, "///")]
    asked = [("own", "open «plans\\floor 2/001_содержание.pdf», please"), ("two", "001_Содержание.pdf"), ("stem", "the long_report_name?"), ("exact", "is it 01_Содержание.pdf"), ("short", "a"), ("no", "xa.b or a.by"), ("dot", "see a.b."), (None, None)]
    frame = spark.createDataFrame(files, "file_id long, path string"), spark.createDataFrame(asked, "question_id string, question string")
    got = {r["question_id"]: (r["status"], r["matches"], r["file_id"]) for r in N.resolved(frame[1], frame[0]).collect()}
    assert got == {"own": ("matched", 1, 1), "two": ("ambiguous", 2, None), "stem": ("matched", 1, 3), "exact": ("matched", 1, 5), "dot": ("matched", 1, 4)}
    assert N.resolved(frame[1], frame[0].limit(0)).count() == 0


def test_replies_go_to_the_nearest_known_message(spark):
    rows = [("a", None, None), ("b", "a", ["a"]), ("c", "lost", ["a", "b", "lost"]), ("d", "lost", ["gone"]), ("e", None, ["a", "b"]), (None, "a", None)]
    got = N.reply_edges(spark.createDataFrame(rows, "id string, in_reply_to string, refs array<string>")).collect()
    assert {r["message"]: r["reply_to"] for r in got} == {"b": "a", "c": "b", "e": "b", None: "a"}


def chain_end(up, k):
    seen = []
    while k in up and up[k] is not None and k not in seen:
        seen.append(k)
        k = up[k]
    return min(seen[seen.index(k) :]) if k in seen else k


def test_roots_of_chains_trees_and_cycles(spark):
    r = random.Random(9)
    up = {k: k - 1 if k else None for k in range(70)} | {100 + k: r.choice([None, 999, *range(100, 140)]) for k in range(40)} | {200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 205: 205}
    links = spark.createDataFrame(list(up.items()), "id long, up long").repartition(3)
    assert {x["id"]: x["root"] for x in N.roots(links).collect()} == {k: chain_end(up, k) for k in up}
    assert N.roots(links.limit(0)).count() == 0


def plainly(parts, chars, items, units):
    held = sorted(parts)
    while held and (1 + sum(len(b) + 1 for *_, b in held) > chars or len(held) > items or len({u for _, _, u, _ in held if u}) > units):
        held.pop()
    return held


def test_answers_fit_three_limits_at_their_edges(spark):
    r = random.Random(2)
    for chars, items, units in ((60, 9, 9), (61, 9, 9), (500, 3, 9), (500, 9, 2), (1, 9, 9), (10_000, 99, 99)):
        parts = {f"q{k}": [(kind, n, r.choice("abc") if kind == 0 else None, "x" * r.randint(0, 12)) for kind in range(3) for n in range(r.randint(0, 5))] for k in range(9)}
        rows = [(q, *p) for q, group in parts.items() for p in group]
        got = N.fitted(spark.createDataFrame(rows, "q string, kind int, rank int, unit string, body string"), "q", chars, items, units).collect()
        assert sorted((x["q"], x["kind"], x["rank"]) for x in got) == sorted((q, *p[:2]) for q, group in parts.items() for p in plainly(group, chars, items, units))

"""Structured embedding chunks: rows survive, no chunk passes its budget, and all are what a plain walk makes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import embedding as E, reading as R

TOKEN = re.compile(r"[^\W]+|[^\w\s]")


def cost(text, unit):
    return len(TOKEN.findall(text)) if unit == "tokens" else len(text)


def cut(context, body, partial, budget, search):
    """Chunks of prose by a plain walk over pieces."""
    room = budget.size - cost(search, budget.unit) - cost(context, budget.unit)
    if cost(body.strip(), budget.unit) <= room:
        return [(context + body.strip(), partial)] if body.strip() else []
    pieces = re.findall(r"^\s+|(?:\w+|[^\w\s])\s*", body)
    if budget.unit == "characters":
        pieces = [p[k : k + max(1, room)] for p in pieces for k in range(0, len(p), max(1, room))]
    weigh = (lambda p: int(bool(p.strip()))) if budget.unit == "tokens" else len
    overlap = 0 if partial else min(budget.overlap, max(0, budget.size - 1), max(0, room - 1))
    out, at = [], 0
    while at < len(pieces):
        end, used = at, 0
        while end < len(pieces) and (end == at or used + weigh(pieces[end]) <= room):
            used, end = used + weigh(pieces[end]), end + 1
        while end < len(pieces) and weigh(pieces[end]) == 0:
            end += 1
        text = "".join(pieces[at:end]).strip()
        if text:
            out.append((context + text, partial))
        if end == len(pieces):
            break
        low = end
        while low > at + 1 and sum(map(weigh, pieces[low - 1 : end])) <= overlap:
            low -= 1
        while overlap and low < end and not re.search(r"\s$", pieces[low - 1]):
            low += 1
        at = low if overlap else end
    return out


def plainly(unit, budget, search):
    weigh = lambda t: cost(t, budget.unit)
    if unit["kind"] != "table_rows":
        if unit["prefix"] and weigh(search) + weigh(unit["prefix"]) >= budget.size:
            return cut("", unit["prefix"], True, budget, search) + cut("", unit["body"], True, budget, search)
        return cut(unit["prefix"], unit["body"], False, budget, search)
    header, out = unit["table_header"], []
    context = (unit["heading"] + "\n\n" if unit["heading"] else "") + header
    full = weigh(search) + weigh(context) >= budget.size
    if full:
        out, context = cut("", context, True, budget, search), ""
    body = unit["body"].removeprefix(header) if header else unit["body"]
    room, held = budget.size - weigh(search) - weigh(context), ""
    for row in re.findall(r"[^\n]*\n|[^\n]+", body):
        own = weigh(row)
        if held and weigh(held) + own > room:
            out.append((context + held.strip(), full))
            held = ""
        if own > room:
            out += cut(context, row, True, budget, search) if weigh(row.strip()) > room else [(context + row.strip(), full)]
        else:
            held += row
    if held:
        out.append((context + held.strip(), full))
    if not body.strip() and header and not full:
        out += cut("", context, False, budget, search)
    return out


def documents():
    r = random.Random(7)
    word = lambda: r.choice(["pump", "DN_100", "17.25", "a-b-c", "é", "valve,", "«x»", "Я" * 30, "w" * 90])
    row = lambda n: "|" + "|".join(" ".join(word() for _ in range(r.randint(0, 3))) for _ in range(n)) + "|\n"
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(r.randint(1, 6)):
            kind = r.random()
            if kind < 0.25:
                parts.append("#" * r.randint(1, 3) + " " + " ".join(word() for _ in range(r.randint(1, 12))) + "\n")
            elif kind < 0.6:
                n = r.randint(1, 4)
                parts.append(row(n) + "|" + "---|" * n + "\n" + "".join(row(n) for _ in range(r.randint(0, 12))) + "\n")
            else:
                parts.append("  " + " ".join(word() for _ in range(r.randint(1, 120))) + "\n\n")
        texts.append("".join(parts))
    return texts + ["", None, " \n ", "x", "word " * 400]


@pytest.mark.parametrize("budget", [E.Budget(24, 5), E.Budget(60), E.Budget(9, 3), E.Budget(120, 30, "characters"), E.Budget(40, 0, "characters")])
def test_chunks_equal_a_plain_walk(spark, budget):
    docs = spark.createDataFrame(list(enumerate(documents())), "doc_id long, text string")
    units = R.reading_units(docs, 400).persist()
    search = "File: a.docx\n"
    chunks = E.embedding_chunks(units, budget, F.lit(search)).orderBy("doc_id", "ord").collect()
    want = [(u["doc_id"], *part) for u in units.orderBy("doc_id", "ord").collect() for part in plainly(u, budget, search)]
    assert [(c["doc_id"], c["text"], c["partial"]) for c in chunks] == want
    assert all(c["length"] == cost(search + c["text"], budget.unit) <= budget.size for c in chunks)
    assert [c["ord"] for c in chunks if c["doc_id"] == 3] == list(range(sum(c["doc_id"] == 3 for c in chunks)))
    units.unpersist()


def test_rows_stand_whole_under_their_header_once(spark):
    rows = [f"|Valve {i}|1|69.0|\n" for i in range(40)]
    text = "# Equipment\n|Position|Quantity|Mass|\n|---|---|---|\n" + "".join(rows)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = E.embedding_chunks(R.units_for_index(R.reading_units(docs, 12000)), E.Budget(180, 30, "characters"), F.lit("File: equipment.docx\n")).collect()
    for row in rows:
        assert sum(row.strip() in c["text"] for c in chunks) == 1
    assert all("|Position|Quantity|Mass|\n|---|---|---|" in c["text"] and not c["partial"] for c in chunks if "Valve" in c["text"])


def test_ids_follow_document_place_and_text(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "doc_id long, text string")
    budget = E.Budget(4, 1)
    nodes = E.finalized(E.embedding_chunks(R.reading_units(docs, 100), budget), budget).orderBy("doc_id", "ord").collect()
    assert len({n["node_id"] for n in nodes}) == len(nodes) == 4 and [n["text"] for n in nodes][:2] == ["one two three four", "four five six"]
    assert nodes[0]["content_hash"] == nodes[2]["content_hash"] and nodes[0]["node_id"].startswith("1:budget:")
    with pytest.raises(Exception, match="no room"):
        E.embedding_chunks(R.reading_units(docs, 100), budget, F.lit("a b c d")).collect()


def test_spans_of_many_pieces():
    """Cuts of 20,000 pieces are those of a plain walk, found without a pass over all pieces for each of them."""
    costs, heads, room, overlap = [k % 3 for k in range(20000)], list(range(2, 20000, 5)), 80, 16
    found = E._spans(costs, heads, room, overlap)
    at, expected = 0, []
    while at < len(costs):
        end, used = at, 0
        while end < len(costs) and used + costs[end] <= room:
            used, end = used + costs[end], end + 1
        end = max(end, at + 1)
        expected.append((at, end))
        low, used = end, 0
        while low > 0 and used + costs[low - 1] <= overlap:
            low, used = low - 1, used + costs[low - 1]
        at = end if end >= len(costs) else next((h for h in heads if max(low, at + 1) <= h < end), end)
    assert found == expected

"""Importance resampling, decontamination and fill-in-middle against plain versions, on odd and on given tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_words_and_crc import hits, plain_words
from tessella.llm import decontaminate, fim, importance

ODD = "doc_id long, text string, rank string, _carried string, _row_key string, _n string, _output string, _spans string, key string, weight string, `_metadata` string"


def odd_rows():
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(["ab", "cd", "ef", "Gh", "é9"]) for _ in range(n))
    texts = [(1, say(30)), (1, say(25)), (None, say(40)), (None, say(40)), (2, None), (3, ""), (4, " .\n"), (5, "7"), (6, say(30_000)), (7, "a <P> b " * 20), (8, "日本" * 30), (9, "x" * 400 + " y")]
    texts += [(10, say(22))] * 40
    return [(i, t, *("x",) * 9) for i, t in texts]


def draw(rows, target, runs=1, buckets=10_000, percent=10, least=20):
    def feats(text):
        w = plain_words(text)
        return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in feats(x)) for texts in ([x for _, x in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in feats(x))
        out.append([i, len(feats(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    order = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1], o[2]))
    for k, o in enumerate(order[: percent * len(order) // 100]):
        o[4] = k + 1
    return Counter(tuple(o[:5]) for o in out)


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling_equals_a_plain_draw(spark, runs):
    rows, target = odd_rows(), ["ab ab gh", None, "", "cd ef"]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(docs, wanted, runs=runs, percent=30)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()) == draw([r[:2] for r in rows], target, runs, percent=30)
    assert importance.resampled(docs.limit(0), wanted).count() == 0
    none = importance.resampled(docs, wanted.limit(0)).collect()
    assert len(none) == len(rows) and sum(r["rank"] is not None for r in none) == 4


def test_drawn_rows_keep_their_columns(spark):
    rows = odd_rows()
    docs, wanted = spark.createDataFrame(rows, ODD).repartition(3), spark.createDataFrame([("ab gh",)], "text string")
    got = importance.drawn(docs, wanted, percent=50)
    assert got.columns == docs.columns
    ranks = Counter(r["doc_id"] for r in importance.resampled(docs, wanted, percent=50).filter("rank is not null").collect())
    assert Counter(r["doc_id"] for r in got.collect()) == ranks and sum(ranks.values()) == 23


ITEMS = [("1", "Ab cd ef Gh ab cd ef gh ab cd ef é9"), ("22", "cd, cd"), ("22", "ef ef ef"), (None, "gh ab é9 é9 ab"), ("3", None), ("4", ""), ("5", "7"), ("5", "never seen here at all ab")]


@pytest.mark.parametrize("part", [100_000, 12])
def test_decontamination_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    monkeypatch.setattr(decontaminate, "STRETCH", 6)
    rows = [r if len(r[1] or "") < 9000 else (r[0], r[1][:9000], *r[2:]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    for window in (2, 6):
        want = Counter()
        for i, text, *_ in rows:
            marked, named = hits(plain_words(text), [(k, plain_words(x)) for k, x in ITEMS], window)
            names = sorted(n for n in named if n is not None)
            want[i, len(plain_words(text)), len(marked), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(marked)] += 1
        got = decontaminate.contaminated(docs, items, window).drop("words", "items")
        assert Counter(map(tuple, got.collect())) == want
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).filter("contaminated or n_items > 0").count() == 0


def test_removed_spans(spark):
    rows = [(1, "Say: one  two THREE four, and more é"), (2, "one two three"), (3, None), (4, "two one"), (5, "é one two three é one two three ok ok ok ok ok ok ok ok"), (1, "clean")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, _spans string, key int")
    items = spark.createDataFrame([("a", "one two three"), ("b", "two three four")], "item_id string, text string")
    got = decontaminate.removed(docs, items, 3, share=0.5)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(3, None), (4, "two one"), (5, "é  é  ok ok ok ok ok ok ok ok"), (1, "clean"), (1, "Say: , and more é")])
    assert {r["doc_id"] for r in decontaminate.removed(docs, items, 3, longest=3, share=1.0).collect()} == {1, 2, 3, 4, 5}
    assert decontaminate.removed(docs, items, 3, longest=3, share=1.0).filter("doc_id = 1").count() == 1


def plain_fim(i, text):
    text = text or ""
    token = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(token)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (token[:a], token[a:b], token[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    spm = h[3] % 100 < 20
    return i, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_a_plain_cut_and_comes_back(spark):
    r = random.Random(8)
    rows = odd_rows() + [(100 + k, "".join(r.choice(["ab", "<", "<P", "S>", "M>", "é", "日", "😀", " ", "\n", "12", "<M"]) for _ in range(r.randint(1, 30))), *("x",) * 9) for k in range(300)]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    got = fim.fill_in_middle(docs)
    back = got.withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(x)[:6] for x in back) == Counter(plain_fim(i, t) for i, t, *_ in rows)
    assert Counter((x["doc_id"], x["text"]) for x in back) == Counter((i, t or "") for i, t, *_ in rows)
    whole = fim.fill_in_middle_documents(docs)
    assert whole.columns == docs.columns
    assert Counter((x["doc_id"], x["text"], x["_n"]) for x in whole.collect()) == Counter((i, plain_fim(i, t)[5], "x") for i, t, *_ in rows)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0

"""Exact dedup, near-copy and mixing stages with repeated rows and null ids: rows stay or are read one by one."""

from collections import Counter

import corpus_pipeline
from tessella.llm import mixing


def test_repeated_rows_and_null_ids(spark):
    stages = dict(corpus_pipeline.STAGES)
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1), "a")] * 5 + [(1, text(2), "a"), (2, text(1), "a")] + [(None, text(3), "a")] * 4 + [(None, text(4), "b"), (None, text(1), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = Counter([(1, text(1)), (1, text(2)), (None, text(3)), (None, text(4))])
    for name in ("exact dedup", "simhash near-dedup"):
        got = stages[name](spark, docs, "")
        assert got.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    once = mixing.mixed_documents(docs, repetition=1.0).collect()
    assert Counter(map(tuple, once)) == Counter(rows)
    read = mixing.mix(docs, repetition=2.0).groupBy("doc_id").count().collect()
    mixed = mixing.mixed_documents(docs, repetition=2.0)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == {r["doc_id"]: r["count"] for r in read}

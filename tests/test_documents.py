"""Nested documents against a plain recursive walk."""

import json
import random
from collections import Counter

import pytest

from tessella.operators import documents as D


def plainly(value, path="$", owner=None, key=""):
    """(elements, properties) below a value."""
    elements, properties = [], []
    if isinstance(value, dict):
        scalar = lambda v: v is None or isinstance(v, (str, int, float, bool))
        elements.append((path, owner, *(said(value[n]) if n in value and scalar(value[n]) else None for n in ("id", "type"))))
        parts = [(f"{path}.{k}", path, k, v) for k, v in value.items()]
    elif isinstance(value, list):
        parts = [(f"{path}[{i}]", owner, f"{key}[{i}]", v) for i, v in enumerate(value)]
    else:
        return [], [(owner, key, said(value))] if owner is not None else []
    for part in parts:
        e, p = plainly(part[3], *part[:3])
        elements += e
        properties += p
    return elements, properties


def said(value):
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def nested(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice([1, "x", True, None, "Ж", -5, "a.b"])
    if kind < 0.7:
        return {r.choice(["id", "type", "a", "b c", "d"]): nested(r, depth - 1) for _ in range(r.randint(0, 4))}
    return [nested(r, depth - 1) for _ in range(r.randint(0, 3))]


def test_documents_equal_a_plain_walk(spark):
    r = random.Random(8)
    docs = [nested(r, 6) for _ in range(120)] + [{"a": {"a": {"a": {"a": {"a": [[{"b": 1}]]}}}}}, {}, [], [1, [2, {"x": 3}]]]
    rows = [(k, json.dumps(d)) for k, d in enumerate(docs)] + [(900, "not json"), (901, None), (902, "")]
    found = D.walk(spark.createDataFrame(rows, "doc_id long, json string").repartition(3))
    want = [plainly(d) for d in docs]
    assert Counter(map(tuple, found.elements.collect())) == Counter((k, *e) for k, (es, _) in enumerate(want) for e in es)
    assert Counter(map(tuple, found.properties.collect())) == Counter((k, *p) for k, (_, ps) in enumerate(want) for p in ps)


def test_depth_is_bounded(spark):
    deep = "[" * 9 + "]" * 9
    docs = spark.createDataFrame([(1, deep)], "doc_id long, json string")
    assert D.walk(docs, depth=10).elements.count() == 0
    with pytest.raises(ValueError, match="levels"):
        D.walk(docs, depth=8)
    assert D.walk(docs.limit(0)).elements.count() == 0

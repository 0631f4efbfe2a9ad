"""Clusters of names against the plain loop."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import tables as T


def plainly(names):
    clusters = []
    for n in sorted(set(names)):
        for c in clusters:
            if any(min(len(n), len(o)) >= 4 and (n in o or o in n) for o in c):
                c.append(n)
                break
        else:
            clusters.append([n])
    return {n: c[0] for c in clusters for n in c}


def handed_on(names):
    """The least first name among those of matching earlier names, which is what the rounds compute."""
    first = {}
    for n in sorted(set(names)):
        first[n] = min((first[o] for o in first if min(len(n), len(o)) >= 4 and (n in o or o in n)), default=n)
    return first


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9), max_size=14))
def test_the_oldest_matching_cluster_is_the_least_one_handed_on(names):
    assert plainly(names) == handed_on(names)


def test_clusters_of_several_units(spark):
    r = random.Random(4)
    rows = [(u, "".join(r.choice("abc ") for _ in range(r.randint(1, 12)))) for u in ("m", "kg", None) for _ in range(120)]
    rows += [("m", "abcd" + "x" * k) for k in range(12)] + [("m", "zzzz" + "y" * k + "abcd") for k in range(4)] + [("m", None)]
    got = T.name_clusters(spark.createDataFrame(rows, "unit string, name string"), "unit", "name").collect()
    for unit in ("m", "kg"):
        assert {g["name"]: g["cluster"] for g in got if g["unit"] == unit} == plainly([n for u, n in rows if u == unit and n is not None])
    assert T.name_clusters(spark.createDataFrame(rows[:1], "unit string, name string").limit(0), "unit", "name").count() == 0

"""The lazy choice of context against the plain greedy one, in a task and over rounds, and what its limits and merging do."""

import math
import random
import tempfile
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators import selection as S

WORDS = ["pump", "flow", "pressure", "17.25", "valve", "of", "the"]


def plainly(units, weights, limits):
    """Each step scores every unit that is left and takes the best, the first of equals."""
    whole, covered, groups, chosen, out = sum(weights.values()), set(), set(), [], []
    left, text_left = limits.max_chars, limits.max_chars if limits.text_chars is None else limits.text_chars
    while len(chosen) < limits.items:
        best = None
        for u in sorted(units):
            if u in chosen or (u.group not in groups and len(groups) >= limits.sources) or (not limits.peers and (u.cost > left or u.size > text_left)):
                continue
            value = S.score(u, S.novelty(u, covered, weights, whole) if whole else 0.0, max([0.0, *(S.redundancy(u, c) for c in chosen)]), whole)
            if best is None or value > best[1]:
                best = u, value
        if best is None:
            break
        chosen.append(best[0])
        out.append((best[0].position, best[1]))
        groups.add(best[0].group)
        covered |= best[0].terms
        left, text_left = left - best[0].cost, text_left - best[0].size
    return out


def built(parts, weights, limits):
    whole, units = sum(weights.values()), []
    for k, (terms, group, rank, size, peer) in enumerate(parts):
        matched = frozenset(terms) & set(weights)
        cover = sum(weights[t] for t in weights if t in matched) / whole if whole else 0.0
        relevance = 0.35 * 10 / (10 + rank) + 0.65 * cover
        load = math.sqrt(1 + max((size + 80) / limits.max_chars, size / (limits.text_chars or limits.max_chars)))
        units.append(S.Unit(k, group, frozenset(terms), matched, relevance, size + 80, size, load, peer, (0.7 * relevance + 0.3 * cover) / load if whole else relevance))
    return units


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.sets(st.sampled_from(WORDS), min_size=1), st.sampled_from("abcde"), st.integers(0, 9), st.integers(1, 300), st.booleans()), max_size=14),
    st.dictionaries(st.sampled_from(WORDS), st.sampled_from([0.5, 1.0, 2.25]), max_size=4), st.integers(1, 6), st.integers(1, 4), st.sampled_from([200, 700, 3000]), st.booleans(), st.integers(1, 14),
)
def test_the_lazy_choice_is_the_greedy_one(parts, weights, items, sources, chars, peers, seen):
    limits = S.Limits(chars, chars // 2, items, sources, 0, peers)
    units, want = built(parts, weights, limits), plainly(built(parts, weights, limits), weights, limits)
    assert S.lazily(units, weights, limits, None) == (want, True)
    # with only the best by bound, a choice that is called sure is the whole one
    by_bound = sorted(units, key=lambda u: (-u.bound, u.position))
    found, sure = S.lazily(by_bound[:seen], weights, limits, by_bound[seen].bound if len(units) > seen else None)
    assert found == want[: len(found)] and (not sure or found == want)


UNITS = "question_id string, position long, source string, unit_id string, grp string, heading string, text string, rank int, source_rank int"
ASKED = "question_id string, question string"


def unit(k, text, rank, source_rank=None, source=None, grp=None, heading=None, q="q"):
    return q, k, source or f"s{k}", f"u{k}", grp, heading, text, rank, source_rank


def test_rounds_give_what_one_group_gives(spark):
    r = random.Random(5)
    rows = [unit(k, " ".join(r.choice(WORDS + ["x%d" % r.randint(0, 30)]) for _ in range(r.randint(1, 25))), r.choice([None, *range(8)]), r.choice([None, 0, 3]), grp=r.choice("abcdef"), q=f"q{k % 3}") for k in range(240)]
    units, asked = spark.createDataFrame(rows, UNITS).repartition(3), spark.createDataFrame([(f"q{k}", "pump pressure of 17.25 flow") for k in range(3)], ASKED)
    for peers in (False, True):
        limits = S.Limits(1500, 900, 7, 4, 100, peers)
        got = [sorted(map(tuple, S.select_context(units, asked, limits, first=n).collect()), key=str) for n in (1, 512)]
        assert got[0] == got[1] and len(got[0]) > 9


def test_copies_share_a_text_and_keep_their_places(spark):
    rows = [unit(0, "Pressure  17.25\r\nbar", 5), unit(1, "Pressure 17.25\n\n bar", 0, 4), unit(2, "Pressure 117.250\nbar", 1), unit(3, " \n", 0), unit(4, "other", None), unit(2, "again", 0), unit(5, "Pressure 17.25\nbar", 3, heading="Other heading")]
    units, places = S.merged(spark.createDataFrame(rows, UNITS))
    kept = {r["unit_id"]: r for r in units.collect()}
    assert set(kept) == {"u0", "u2", "u4", "u5"} and kept["u0"]["rank"] == 0 and kept["u0"]["source_rank"] == 4 and kept["u0"]["copies"] == 1
    same = {r["unit_id"] for r in places.collect() if r["content"] == kept["u0"]["content"]}
    assert same == {"u0", "u1"}
    got = S.select_context(spark.createDataFrame(rows, UNITS), spark.createDataFrame([("q", "Pressure")], ASKED), S.Limits(5000)).collect()
    assert {r["unit_id"] for r in got} == {"u0", "u2", "u5"}  # the one without a rank or a matched term isn't relevant


def test_limits(spark):
    long = "Pump pressure and flow. " + "Detailed technical explanation. " * 100
    rows = [unit(0, long, 0), unit(1, "Pump pressure and flow\n|Item|Pressure|Flow|\n|A|17.25 bar|8 l/s|", 10)]
    asked = spark.createDataFrame([("q", "Pump pressure and flow"), ("none", "x")], ASKED)
    got = S.select_context(spark.createDataFrame(rows, UNITS), asked, S.Limits(10**6, len(long))).collect()
    assert "u1" in {r["unit_id"] for r in got} and sum(len(rows[r["position"]][6]) for r in got) <= len(long)
    one = [unit(k, f"pump {k}", k, source="a" if k < 3 else f"s{k}") for k in range(6)]
    got = S.select_context(spark.createDataFrame(one, UNITS), asked, S.Limits(9000, sources=1)).collect()
    assert {r["source"] for r in got} == {"a"} and len(got) == 3
    assert S.select_context(spark.createDataFrame([], UNITS), asked, S.Limits(9000)).count() == 0


def test_groups_stay_small_while_bounds_are_loose(spark, monkeypatch):
    """Units that all match the question are bounded anew after every choice; no round takes more of them."""
    rows = [unit(k, f"pump pressure {' '.join(f'w{(k * 7 + j) % 97}' for j in range(k % 11 + 1))}", None, k % 40) for k in range(400)]
    units, asked = spark.createDataFrame(rows, UNITS), spark.createDataFrame([("q", "pump pressure")], ASKED)
    limits, sizes, plain = S.Limits(5000, items=6), [], S._round
    monkeypatch.setattr(S, "_round", lambda limits, most: sizes.append(most) or plain(limits, most))
    got, whole = ([tuple(r) for r in S.select_context(units, asked, limits, first=n).orderBy("nth").collect()] for n in (8, 512))
    assert got == whole and len(got) == 6
    assert set(sizes[:-1]) == {8}


def test_equal_scores_do_not_make_a_group_larger(spark, monkeypatch):
    """More units of one score than a group holds: the first by position is chosen, and rounds stay as small."""
    rows = [unit(k, f"pump pressure x{k * 37 % 100 + 100}", None, 3) for k in range(100)]
    units, asked = spark.createDataFrame(rows, UNITS).repartition(3), spark.createDataFrame([("q", "pump pressure")], ASKED)
    limits, sizes, plain = S.Limits(5000, items=3), [], S._round
    monkeypatch.setattr(S, "_round", lambda limits, most: sizes.append(most) or plain(limits, most))
    got = [r["position"] for r in S.select_context(units, asked, limits, first=8).orderBy("nth").collect()]
    assert got == [0, 1, 2] and set(sizes) == {8}


def test_texts_are_not_written(spark, monkeypatch):
    """What selection writes doesn't grow with the units' texts."""
    r = random.Random(3)
    rows = [unit(k, "pump " + " ".join("%08x" % r.getrandbits(32) for _ in range(600)), None, k % 40) for k in range(200)]
    units, asked = spark.createDataFrame(rows, UNITS), spark.createDataFrame([("q", "pump pressure")], ASKED)
    monkeypatch.setattr(S, "discard", lambda df: None, raising=False)
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    assert S.select_context(units, asked, S.Limits(10**5, items=4)).count() == 4
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) < sum(len(row[6]) for row in rows) // 2


def test_repeated_units_are_found_by_hash(spark):
    rows = [unit(k, f"pump w{k}", k, source="a", q=f"q{k % 2}") for k in range(6)] + [unit(9, "pump again", 0, source="a")]
    rows = [(*row[:3], "u", *row[4:]) if k in (0, 2) else row for k, row in enumerate(rows)]
    units = S.merged(spark.createDataFrame(rows, UNITS))[0]
    assert sorted((r["question_id"], r["position"]) for r in units.collect()) == [("q", 9), ("q0", 0), ("q0", 4), ("q1", 1), ("q1", 3), ("q1", 5)]

"""Sections under a budget and topics' reading lists on small worked cases."""

from tessella.operators import reading as R

OBJECTS = "q string, kind int, required boolean, position int, id string, tokens long, fallback array<long>"


def taken(spark, rows, budget):
    found = R.pack_sections(spark.createDataFrame(rows, OBJECTS), "q", budget).collect()
    return sorted((r["q"], r["overflow"], r["id"], r["part"], r["tokens"]) for r in found if r["part"] is not None), sorted(r["id"] for r in found if r["part"] is None)


def test_required_objects_come_first_and_blocks_stand_in_for_wholes(spark):
    rows = [("a", 0, False, 1, "x", 6, [3, 2]), ("a", 1, True, 1, "need", 5, None), ("a", 1, False, 2, "y", 2, None), ("a", 2, False, 3, "z", 9, [])]
    # 5, then x's 6 don't fit in 10 with a separator; its block of 3 does (9 used), nothing else
    assert taken(spark, rows, 10) == ([("a", False, "need", 0, 5), ("a", False, "x", 1, 3)], ["y", "z"])


def test_a_separator_counts(spark):
    rows = [("a", 0, False, 1, "x", 5, None), ("a", 0, False, 2, "y", 5, None)]
    assert taken(spark, rows, 10)[0] == [("a", False, "x", 0, 5)]
    assert len(taken(spark, rows, 11)[0]) == 2


def test_required_objects_beyond_the_budget_are_named_alone(spark):
    rows = [("a", 0, True, 1, "x", 6, [1]), ("a", 0, True, 2, "y", 6, None), ("a", 1, False, 3, "z", 1, None), ("b", 0, False, 1, "w", 1, None)]
    assert taken(spark, rows, 12) == ([("a", True, "x", 0, 6), ("a", True, "y", 0, 6), ("b", False, "w", 0, 1)], [])


def test_no_objects(spark):
    assert taken(spark, [], 10) == ([], [])


def test_topic_plan_keeps_first_sight_and_limits(spark):
    topics = spark.createDataFrame([("s", "t1", 3), ("s", "t2", 9), ("s", "t3", 1)], "scope string, topic string, score int")
    sections = spark.createDataFrame([("s", "t2", 1, "f", "h1"), ("s", "t2", 2, "g", "h1"), ("s", "t1", 1, "f", "h1"), ("s", "t3", 1, "never", "h")], "scope string, topic string, position int, file string, heading string")
    files = spark.createDataFrame([("s", "t2", 1, "e"), ("s", "t1", 1, "g"), ("s", "t1", 2, "d")], "scope string, topic string, position int, file string")
    a, b = R.topic_plan(topics, sections, files, "scope", most_sections=1, most_files=3)
    assert [(r["file"], r["heading"], r["topic"]) for r in a.orderBy("nth").collect()] == [("f", "h1", "t2")]
    assert [(r["file"], r["leg"]) for r in b.orderBy("nth").collect()] == [("f", 0), ("g", 0), ("e", 1)]

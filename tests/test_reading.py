"""Reading units, structured chunks, cells, placed tables and sheet addresses, against plain rules and odd input."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import reading as R

PIECES = st.lists(st.sampled_from(["# a\n", "## b c\n", "####### x\n", "\n", "plain words here. ", "one\n", "| a | b |\n", "|---|---|\n", "| 1 | 2 |\n", "x" * 50, "  \t\n", "é я\n"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 60))
def test_units_join_to_the_text(pieces, budget):
    text = "".join(pieces)
    found = list(R.units(text, budget))
    assert "".join(u[6] for u in found) == text
    assert all(text[u[5] : u[5] + len(u[6])] == u[6] for u in found)
    assert all(u[0] != "table_rows" or u[6].count("\n") <= u[4] - u[3] for u in found)


def test_units_name_headings_and_repeat_headers():
    text = "# A\nfirst\n## B\n| x | y |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\nlast"
    found = list(R.units(text, 20))
    assert [(u[0], u[1], u[6]) for u in found][:3] == [("paragraph", "# A", "# A\n"), ("paragraph", "# A", "first\n"), ("paragraph", "# A\n## B", "## B\n")]
    rows = [u for u in found if u[0] == "table_rows"]
    assert [(u[3], u[4], u[7]) for u in rows] == [(0, 2, "# A\n## B\n\n"), (2, 4, "# A\n## B\n\n| x | y |\n|---|---|\n")]
    assert all(u[8] for u in rows)


def test_index_leaves_out_repeated_headings(spark):
    docs = spark.createDataFrame([(1, "# A\nfirst\n## B\nsecond"), (2, None), (3, ""), (4, "# alone")], "doc_id long, text string")
    kept = R.units_for_index(R.reading_units(docs, 100)).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["body"]) for r in kept] == [(1, "first\n"), (1, "## B\n"), (1, "second"), (4, "# alone")]


def test_structured_chunks():
    assert list(R.structured("1.1 one\n1.2 two\n", 100, 0)) == ["1.1 one\n\n1.2 two"]
    assert list(R.structured("1.1 one\n1.2 two\n", 9, 0)) == ["1.1 one", "1.2 two"]
    assert list(R.structured("Aa bb. Cc dd. Ee ff.", 14, 7)) == ["Aa bb. Cc dd.", "Cc dd. Ee ff."]
    assert list(R.structured("abcdefghij", 4, 1)) == ["abcd", "defg", "ghij", "j"]
    assert list(R.structured(" \n", 4, 1)) == []
    assert R.clauses("1.1 a\n  1.2 b\n\t1.3 c") == ["1.1 a", "1.2 b", "1.3 c"]
    assert list(R.structured("One two three. Four five six. Seven", 16, 5)) == ["One two three.", "hree. Four five six.", "six. Seven"]
    quarter = lambda t: max(1, len(t) // 4)
    found = list(R.structured("\n".join(f"1.{k} " + "word " * 20 for k in range(6)), 50, 5, quarter))
    assert len(found) > 2 and all(quarter(c) <= 50 + 5 + 2 for c in found) and found[1].startswith("word")


@settings(max_examples=200, deadline=None)
@given(PIECES, st.integers(4, 60))
def test_structured_chunks_lose_nothing(pieces, size):
    text = "".join(pieces)
    assert "".join("".join(R.structured(text, size, 0)).split()) == "".join(text.split())
    assert all(len(c) <= size for c in R.structured(text, size, 0))


def test_cells_come_back(spark):
    cells = [["a|b", "c"], ["", "x y"], ["|", "|||"]]
    rows = spark.createDataFrame([(c,) for c in cells], "c array<string>").select("c", R.row_cells(R.escaped_row(F.col("c"))).alias("back")).collect()
    assert all(r["c"] == r["back"] for r in rows)


def test_appendix_places(spark):
    base = spark.createDataFrame([(f"b{k}", k) for k in range(1, 7)], "key string, position int")
    order = lambda tables: [r["key"] for r in R.with_appendix(base, spark.createDataFrame(tables, "key string, nth int"), ["key"], 4, 2).orderBy("final").collect()]
    assert order([("t1", 1), ("b6", 2), ("t3", 3)]) == ["b1", "b2", "t1", "b6", "b3", "b4", "b5", "t3"]
    assert order([("b2", 1), ("t2", 2)]) == ["b1", "b2", "b3", "b4", "b5", "b6", "t2"]
    assert order([]) == [f"b{k}" for k in range(1, 7)]


def test_sheet_addresses(spark):
    asked = {
        "лист «Смета» строки 3–5 и 9": ("Смета", [3, 4, 5, 9]),
        "worksheet Plan row 7, 7, 2": ("Plan", [2, 7]),
        "sheet 'A b' rows 5 - 9000000000": ("A b", None),
        "sheet A rows 99999999999999999999": ("A", None),
        "sheet A rows 9-3": ("A", None),
        "sheet A. rows 3": ("A", None),
        "rows 3": (None, None),
    }
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", X.sheet_rows(F.col("q")).alias("a")).collect()
    assert {r["q"]: (r["a"]["sheet"], r["a"]["rows"]) for r in rows} == asked


def test_registered_units_and_chunks(spark):
    from tessella.plans import registry

    units = registry.QUERIES["reading_units"](spark, "/root/testdata/sf0.001")
    assert units.filter("length(prefix) = 0 AND ord > 0 AND heading <> '' AND NOT startswith(body, '#')").count() == 0
    chunks = registry.QUERIES["structured_chunks"](spark, "/root/testdata/sf0.001")
    assert 0 < chunks.filter("length(chunk) <= 1102").count() == chunks.count()

"""Chunks for embedding: reading units cut under a budget of tokens or characters, with the headings and table headers above them.

Table rows are atomic: they are packed whole, each chunk under its caption and header. What is longer than the budget (a row, a
header, a heading) is cut into slices that are marked as partial, to be read at
the source. Prose is cut between words, and the next
chunk begins with the last words of the one before. All of this is done inside each unit's row by array functions (the places
where prose is cut are looked up in running sums by numpy), so that nothing is shuffled but the running number of a document's chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

#: A token: a run of letters, digits and low lines, or any other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_EDGE = r"^\s+|\s+$"


class Budget(NamedTuple):
    """size: tokens or characters of a chunk with all that stands before it; overlap: of those, what prose repeats."""

    size: int
    overlap: int = 0
    unit: str = "tokens"


def length(text: Column | str, unit: str = "tokens") -> Column:
    return (F.regexp_count(text, F.lit(TOKEN)) if unit == "tokens" else F.length(text)).cast("int")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def _pieces(text: Column, unit: str, room: Column) -> Column:
    """Parts that join to the text: tokens with the white space around them; in characters none is longer than room."""
    found = F.regexp_extract_all(text, F.lit(rf"^\s+|(?:{TOKEN})\s*"), F.lit(0))
    if unit == "tokens":
        return found
    size = F.greatest(room, F.lit(1))
    return F.flatten(F.transform(found, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda k: F.substring(p, k * size + 1, size))))


def _spans(costs: list[int], heads: list[int], room: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (a, b) of each chunk of a row, from 0: as many as fit; the next begins at a word, with at most overlap of the last
    repeated. heads: pieces that stand after white space. Each end is looked up in the running sum of costs."""
    sums, heads, n = np.concatenate([[0], np.cumsum(costs, dtype=np.int64)]), np.asarray(heads, np.int64), len(costs)
    at, out = 0, []
    while at < n:
        end = min(max(int(np.searchsorted(sums, sums[at] + room, "right")) - 1, at + 1), n)
        out.append((at, end))
        if overlap > 0 and end < n:
            low = max(int(np.searchsorted(sums, sums[end] - overlap)), at + 1)
            k = int(np.searchsorted(heads, low))
            at = int(heads[k]) if k < len(heads) and heads[k] < end else end
        else:
            at = end
    return out


def _spans_of(batches: Iterator[tuple]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([[{"a": a, "b": b} for a, b in _spans(*row)] if len(row[0]) else [] for row in zip(*batch, strict=True)], dtype=object)


def _grouped() -> Column:
    """Texts of a row's table rows (_rows, _costs): as many as fit into _room, one that doesn't alone."""
    start = F.struct(F.lit(-1).alias("group"), F.lit(None).cast("int").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        # a row that is too long is alone, which no room left tells the next one
        joins = F.coalesce(s["used"] + c <= F.col("_room"), F.lit(False))
        group = F.when(joins, s["group"]).otherwise(s["group"] + 1)
        used = F.when(joins, s["used"] + c).when(c <= F.col("_room"), c)
        return F.struct(group.alias("group"), used.cast("int").alias("used"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate("_costs", start, step, lambda s: s["out"])


_SEGMENT = "struct<context:string,body:string,whole:boolean,cut:boolean>"


def _segment(context: Column, body: Column, whole: Column | bool, cut: Column | bool) -> Column:
    """A context and a body, and whether its chunk is partial if it stays whole and if it is cut."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(context.alias("context"), body.alias("body"), column(whole).alias("whole"), column(cut).alias("cut"))


def _segments(units: DataFrame, budget: Budget) -> DataFrame:
    """doc_id, ord, _search, _s (its length) and _segments of every unit."""
    none, empty = F.lit(""), F.array().cast(f"array<{_SEGMENT}>")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    table = F.col("kind") == "table_rows"
    caption = F.concat(F.when(text("heading") != "", F.concat(F.col("heading"), F.lit("\n\n"))).otherwise(""), text("table_header"))
    rows = units.select("doc_id", "ord", "_search", "_s", table.alias("_table"), F.when(table, caption).otherwise(text("prefix")).alias("_context"), text("table_header").alias("_header"), text("body").alias("_body"))
    rows = rows.withColumn("_full", (F.col("_context") != "") & (F.col("_s") + length("_context", budget.unit) >= budget.size))
    rest = F.when((F.col("_header") != "") & F.startswith("_body", F.col("_header")), F.substring("_body", F.length("_header") + 1, F.length("_body"))).otherwise(F.col("_body"))
    lines = F.when(F.col("_table"), F.regexp_extract_all(rest, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"_room": budget.size - F.col("_s") - F.when(F.col("_full"), 0).otherwise(length("_context", budget.unit)), "_rows": lines})
    rows = rows.withColumn("_costs", F.transform("_rows", lambda r: length(r, budget.unit))).withColumn("_numbers", _grouped())
    pairs = F.arrays_zip(F.col("_rows").alias("row"), F.col("_numbers").alias("group"))
    last = F.coalesce(F.try_element_at("_numbers", F.lit(-1)), F.lit(-1))
    joined = F.transform(F.sequence(F.lit(0), last), lambda g: F.array_join(F.transform(F.filter("_pairs", lambda p: p["group"] == g), lambda p: p["row"]), ""))
    rows = rows.withColumn("_pairs", pairs).withColumn("_texts", F.when(last >= 0, joined).otherwise(F.array().cast("array<string>")))
    full, context, body = F.col("_full"), F.col("_context"), F.col("_body")
    own = F.when(full, none).otherwise(context)
    header = F.when(full, F.array(_segment(none, context, True, True))).when(F.forall("_rows", lambda r: trimmed(r) == "") & (F.col("_header") != ""), F.array(_segment(none, context, False, False))).otherwise(empty)
    of_rows = F.transform("_texts", lambda t: _segment(own, t, full, True))
    of_prose = F.when(full, F.array(_segment(none, context, True, True), _segment(none, body, True, True))).otherwise(F.array(_segment(context, body, False, False)))
    return rows.select("doc_id", "ord", "_search", "_s", F.when(F.col("_table"), F.concat(header, of_rows)).otherwise(of_prose).alias("_segments"))


def embedding_chunks(units: DataFrame, budget: Budget, search: Column | None = None) -> DataFrame:
    """doc_id, ord, text, length, partial, search of the chunks of reading units (doc_id, ord, kind, heading, prefix, table_header, body).

    search: text that is embedded before each chunk but isn't in it; it counts, and one that leaves no room is an error. length is
    that of the search text and the chunk. Units of white space give no chunks; nulls count as empty.
    """
    before = F.coalesce(search if search is not None else F.lit(""), F.lit(""))
    checked = F.when(length(before, budget.unit) < budget.size, before).otherwise(F.raise_error(F.lit("the search text leaves no room in the budget")).cast("string"))
    rows = _segments(units.withColumn("_search", checked).withColumn("_s", length("_search", budget.unit)), budget)
    # outer: for an inner one the optimizer tests the array's size first, and for that makes every unit's segments anew in one expression
    rows = rows.select("doc_id", "ord", "_search", "_s", F.posexplode_outer("_segments").alias("_segment", "_x")).filter("_x IS NOT NULL").select("doc_id", "ord", "_segment", "_search", "_s", "_x.*")
    rows = rows.withColumns({"_plain": trimmed(F.col("body")), "_room": budget.size - F.col("_s") - length("context", budget.unit)})
    rows = rows.withColumn("_fits", length("_plain", budget.unit) <= F.col("_room"))
    # a body that fits has no pieces
    rows = rows.withColumn("_pieces", F.when(F.col("_fits"), F.array().cast("array<string>")).otherwise(_pieces(F.col("body"), budget.unit, F.col("_room"))))
    cost = F.transform("_pieces", lambda p: F.when(trimmed(p) == "", 0).otherwise(1) if budget.unit == "tokens" else F.length(p))
    heads = F.filter(F.transform("_pieces", lambda p, i: F.when(p.rlike(r"\s$"), i + 1)), lambda i: i.isNotNull())
    most = F.when(F.col("cut"), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(min(budget.overlap, budget.size - 1)), F.col("_room") - 1)))
    spans = F.pandas_udf(_spans_of, "array<struct<a:int,b:int>>", PandasUDFType.SCALAR_ITER)
    rows = rows.withColumns({"_costs": cost, "_heads": heads, "_overlap": most}).withColumn("_spans", spans("_costs", "_heads", "_room", "_overlap"))
    slices = F.transform("_spans", lambda s: trimmed(F.array_join(F.slice("_pieces", s["a"] + 1, s["b"] - s["a"]), "")))
    rows = rows.withColumn("_texts", F.filter(F.when(F.col("_fits"), F.array("_plain")).otherwise(slices), lambda t: t != ""))
    earlier = Window.partitionBy("doc_id").orderBy("ord", "_segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("doc_id", "ord", "_segment", "_search", "context", F.when(F.col("_fits"), F.col("whole")).otherwise(F.col("cut")).alias("partial"), "_texts")
    rows = rows.withColumn("_first", F.coalesce(F.sum(F.size("_texts")).over(earlier), F.lit(0)))
    parts = rows.select("doc_id", "_search", "_first", "partial", "context", F.posexplode("_texts").alias("_n", "_text"))
    parts = parts.select("doc_id", (F.col("_first") + F.col("_n")).cast("int").alias("ord"), F.concat("context", "_text").alias("text"), "partial", F.col("_search").alias("search"))
    return parts.select("doc_id", "ord", "text", (length("search", budget.unit) + length("text", budget.unit)).alias("length"), "partial", "search")


def finalized(chunks: DataFrame, budget: Budget) -> DataFrame:
    """Nodes of embedding_chunks(): node_id (the document, the budget's mark and a digest of document, place and text), doc_id,
    ord, text, search, embedding_hash (of search text and chunk), content_hash, length, unit, budget, source_read_required."""
    parent = F.col("doc_id").cast("string")
    digest = F.substring(F.sha1(F.concat_ws("\n", parent, "ord", "text")), 1, 16)
    return chunks.select(
        F.concat(parent, F.lit(":budget:"), digest).alias("node_id"), "doc_id", "ord", "text", "search", F.sha1(F.concat("search", "text")).alias("embedding_hash"), F.sha1("text").alias("content_hash"),
        "length", F.lit(budget.unit).alias("unit"), F.lit(budget.size).alias("budget"), F.col("partial").alias("source_read_required"),
    )

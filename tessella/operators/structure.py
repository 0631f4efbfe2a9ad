"""Lines, sections and trees of documents, computed inside each row where a document is enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import tokens


def best_lines(docs: DataFrame, terms: list[str], most: int) -> DataFrame:
    """doc_id, ord, score: of every document the best lines that hold a term, by the sum of ln(1 + (n - f + 0.5) / (f + 0.5))
    over their terms (n lines, f of them with the term), then by place."""
    lines = F.transform(F.split("text", "\n"), tokens)
    rows = docs.select("doc_id", F.explode(F.array(lines)).alias("_lines")).withColumn("_n", F.size("_lines"))
    holding = lambda term: F.size(F.filter("_lines", lambda w: F.array_contains(w, term)))
    found = {f"_f{i}": holding(t) for i, t in enumerate(terms)}
    rows = rows.withColumns(found)

    def score(words: Column) -> Column:
        total = F.lit(0.0)
        for name, term in zip(found, terms, strict=True):
            total = total + F.when(F.array_contains(words, term), F.log(1 + (F.col("_n") - F.col(name) + 0.5) / (F.col(name) + 0.5))).otherwise(0.0)
        return F.round(total, 6)

    ranked = F.transform("_lines", lambda w, i: F.struct((-score(w)).alias("minus"), i.alias("ord")))
    top = F.slice(F.array_sort(F.filter(ranked, lambda x: x["minus"] < 0)), 1, most)
    return rows.select("doc_id", F.explode(top).alias("x")).select("doc_id", "x.ord", (-F.col("x.minus")).alias("score"))


def tree_levels(docs: DataFrame, fanout: int, most: int) -> DataFrame:
    """doc_id, level, node, leaves, node_id of trees over n leaves in order: a level groups fanout nodes of the one below, and
    is built while that has more than one. docs: doc_id, n. A node's number gives its leaves, so nothing is shuffled."""
    levels = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda v: F.col("n") > F.pow(F.lit(float(fanout)), v - 1))
    width = F.pow(F.lit(float(fanout)), F.col("level")).cast("long")
    nodes = docs.select("doc_id", "n", F.explode(levels).alias("level")).withColumn("_width", width)
    nodes = nodes.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("_width")) - 1)))
    leaves = F.least(F.col("_width"), F.col("n") - F.col("node") * F.col("_width"))
    return nodes.select("doc_id", "level", "node", leaves.alias("leaves"), F.substring(F.sha2(F.concat_ws(":", "doc_id", "level", "node"), 256), 1, 32).alias("node_id"))


def ngrams(rows: DataFrame, n: int, *keep: str) -> DataFrame:
    """keep, gram: distinct sequences of n blank-separated words of every row's text."""
    # a generator of one row, as a split inside the function would cut the text once a sequence
    words = rows.select(*keep, F.explode(F.array(F.split("text", " "))).alias("_words")).filter(F.size("_words") >= n)
    found = F.transform(F.sequence(F.lit(1), F.size("_words") - (n - 1)), lambda i: F.array_join(F.slice("_words", i, F.lit(n)), " "))
    return words.select(*keep, F.explode(F.array_distinct(found)).alias("gram"))


def ngram_coverage(passages: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """item_id, grams, found, coverage: the share of a passage's sequences that some document holds."""
    grams = ngrams(passages, n, "item_id")
    wanted = grams.select("gram").distinct()
    held = ngrams(docs, n).join(wanted, "gram", "left_semi").distinct().withColumn("_held", F.lit(1))
    counted = grams.join(held, "gram", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("grams"), F.count("_held").alias("found"))
    return counted.withColumn("coverage", F.round(F.col("found") / F.col("grams"), 6))


def first_clause(docs: DataFrame, heading: Callable[[Column], Column]) -> DataFrame:
    """doc_id, clause: from the first line that is a heading up to the next; documents without one give no row."""
    rows = docs.select("doc_id", F.split("text", "\n").alias("_lines")).withColumn("_at", F.filter(F.transform("_lines", lambda x, i: F.when(heading(x), i + 1)), lambda i: i.isNotNull()))
    rows = rows.filter(F.size("_at") > 0)
    first, stop = F.element_at("_at", 1), F.when(F.size("_at") > 1, F.get("_at", F.lit(1))).otherwise(F.size("_lines") + 1)
    return rows.select("doc_id", F.array_join(F.slice("_lines", first, stop - first), "\n").alias("clause"))


def heading_paths(parts: DataFrame, levels: int) -> DataFrame:
    """doc_id, ord, path of parts (doc_id, ord, level, title): titles of the headings that a part stands under, its own last.

    A heading is open until one of its own or a lower level follows, so the open one of a level is its last, if that
    comes after the last of every lower level. Parts of a level over levels are under headings but open none.
    """
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = [F.last(F.when(F.col("level") == k, F.struct("ord", "title")), ignorenulls=True).over(so_far).alias(f"_{k}") for k in range(1, levels + 1)]
    rows = parts.select("doc_id", "ord", *opened)
    titles = []
    for k in range(1, levels + 1):
        later = [F.col(f"_{k}.ord") > F.coalesce(F.col(f"_{j}.ord"), F.lit(-1)) for j in range(1, k)]
        titles.append(F.when(F.array_min(F.array(F.lit(True), *later)), F.col(f"_{k}.title")))
    return rows.select("doc_id", "ord", F.array_join(F.array(*titles), " > ").alias("path"))

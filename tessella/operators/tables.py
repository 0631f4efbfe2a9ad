"""Table analytics: headers, mapped columns, exact sums, row search, bills of quantities, reconciliation, prices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.catalog import cut_lineage

EXACT = "decimal(38,12)"


def unique_headers(headers: DataFrame) -> DataFrame:
    """table, pos, name: blank headers become col_N, repeated ones get _2, _3 …"""
    named = headers.withColumn("name", F.when(F.trim(F.coalesce("header", F.lit(""))) == "", F.concat(F.lit("col_"), F.col("pos"))).otherwise(F.trim("header")))
    nth = F.row_number().over(Window.partitionBy("table", "name").orderBy("pos"))
    return named.withColumn("nth", nth).select("table", "pos", F.when(F.col("nth") > 1, F.concat_ws("_", "name", "nth")).otherwise(F.col("name")).alias("name"))


def exact_number(value: Column) -> Column:
    """A decimal from text with blanks, no-break blanks and a comma; null where it is none."""
    return F.translate(F.regexp_replace(value.cast("string"), "[  ]", ""), ",", ".").try_cast(EXACT)


def exact_sum(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Per keys: exact_total, counted, missing, complete."""
    number = exact_number(value)
    return rows.groupBy(*keys).agg(F.sum(number).alias("exact_total"), F.count(number).alias("counted"), F.count_if(number.isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)


def quantities(rows: DataFrame, keys: list[str], qty: str, source: str) -> DataFrame:
    """Bill of quantities: per keys the sum of known quantities, how many lack one, the distinct sources in order."""
    return rows.groupBy(*keys).agg(
        F.round(F.sum(qty), 6).alias("qty"), F.count_if(F.col(qty).isNull()).alias("missing"), F.array_join(F.sort_array(F.collect_set(F.col(source).cast("string"))), ",").alias("sources")
    )


def reconcile(rows: DataFrame, keys: list[str], kind: str, kinds: list[str], qty: str) -> DataFrame:
    """Quantities of the same item from several kinds of source, side by side, with a status."""
    wide = rows.groupBy(*keys).pivot(kind, kinds).agg(F.round(F.sum(qty), 6))
    present = F.size(F.array_compact(F.array(*map(F.col, kinds))))
    most, least = F.greatest(*kinds), F.least(*kinds)
    spread = (present > 1) & (most - least > F.greatest(F.lit(1e-6), most * 0.01))
    status = F.when(F.lit(len(kinds) == 1), "single").when(spread, "mismatch").when(present < len(kinds), "gap").otherwise("match")
    return wide.withColumn("status", status)


def price_analysis(quotes: DataFrame, item: list[str], price: Column, supplier: str) -> DataFrame:
    """Per item: quotes, suppliers, least and greatest net price, median, spread in percent, whether three suppliers suffice."""
    rows = quotes.withColumn("_net", F.round(price, 6))
    return rows.groupBy(*item).agg(
        F.count("_net").alias("quotes"), F.countDistinct(supplier).alias("suppliers"), F.min("_net").alias("low"), F.max("_net").alias("high"), F.round(F.percentile("_net", F.lit(0.5)), 6).alias("median")
    ).withColumns({"spread_pct": F.round((F.col("high") - F.col("low")) / F.nullif(F.col("low"), F.lit(0.0)) * 100, 4), "sufficient": F.col("suppliers") >= 3})


def row_search(rows: DataFrame, words: list[str], terms: Column, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows that hold a query term, by the sum of ln((scanned + 1) / (f + 1)) + 1 over their terms, then by order."""
    hit = {f"_h{i}": F.array_contains(terms, w) for i, w in enumerate(words)}
    marked = rows.withColumns(hit)
    stats = marked.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(h)).alias(h) for h in hit)).first()
    weight = F.lit(0.0)
    for h in hit:
        weight = weight + F.when(F.col(h), F.lit(math.log((stats["n"] + 1) / (stats[h] + 1)) + 1)).otherwise(0.0)
    found = marked.withColumn("weight", F.round(weight, 9)).filter("weight > 0").drop(*hit)
    return found.orderBy(F.col("weight").desc(), *order).offset(offset).limit(limit)


def cell_ranges(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sums of cells (r, c, value) within ranges (name, r1, r2, c1, c2), exact; ranges are a user's few and are broadcast."""
    inside = (F.col("r").between(F.col("r1"), F.col("r2"))) & (F.col("c").between(F.col("c1"), F.col("c2")))
    return cells.join(F.broadcast(ranges), inside).groupBy("name").agg(F.sum(F.col("value").cast(EXACT)).alias("total"), F.count("value").alias("cells"))


def mapped(label: Column, rules: list[tuple[str, str]]) -> Column:
    """The field of the first rule (field, hint) whose hint the lower-case label holds, or null."""
    return F.coalesce(*(F.when(F.contains(F.lower(label), F.lit(hint)), field) for field, hint in rules))


def kind(text: Column, hints: dict[str, list[str]]) -> Column:
    """The kind with the most hints in text, of equals the first; null without any."""
    low = F.lower(text)
    count = {name: sum((F.contains(low, F.lit(h)).cast("int") for h in words), F.lit(0)) for name, words in hints.items()}
    most = F.greatest(*count.values())
    return F.coalesce(*(F.when((c == most) & (most > 0), name) for name, c in count.items()))


def contained_names(names: DataFrame, unit: str, name: str, least: int = 4) -> DataFrame:
    """unit, name, item of distinct names: item is the shortest, then first name of the same unit that name holds, itself
    included; only names of least characters and more are looked for.

    A name holds another only if one of its stretches of least characters is the other's beginning, so names meet by unit
    and stretch, and only then is the whole compared.
    """
    own = names.select(unit, name).filter(F.col(name).isNotNull()).distinct()
    stretches = F.transform(F.sequence(F.lit(1), F.length(name) - least + 1), lambda k: F.substring(F.col(name), k, F.lit(least)))
    long = own.filter(F.length(name) >= least).select(unit, name, F.explode(F.array_distinct(stretches)).alias("_key"))
    short = own.filter(F.length(name) >= least).select(unit, F.col(name).alias("item"), F.substring(name, 1, least).alias("_key"))
    held = long.join(short, [unit, "_key"]).filter(F.contains(name, "item"))
    best = held.groupBy(unit, name).agg(F.min(F.struct(F.length("item"), "item"))["item"].alias("item"))
    return best.unionByName(own.filter(F.length(name) < least).withColumn("item", F.col(name)))


def name_clusters(names: DataFrame, unit: str, name: str, least: int = 4) -> DataFrame:
    """unit, name, cluster of distinct names: what a loop over a unit's names in their order gives that puts each into the oldest
    cluster with a name that matches it (one holds the other, and the shorter has least characters), or opens one.

    That cluster's first name is the least first name among those of all matching earlier names, so first names are handed on
    along such pairs until none falls any more: as many rounds as the longest chain needs, each written once.
    """
    own = names.select(unit, name).filter(F.col(name).isNotNull()).distinct()
    long = own.filter(F.length(name) >= least)
    stretches = F.transform(F.sequence(F.lit(1), F.length(name) - least + 1), lambda k: F.substring(F.col(name), k, F.lit(least)))
    held = long.select(unit, F.col(name).alias("_a"), F.explode(F.array_distinct(stretches)).alias("_key"))
    begun = long.select(unit, F.col(name).alias("_b"), F.substring(name, 1, least).alias("_key"))
    pairs = held.join(begun, [unit, "_key"]).filter((F.col("_a") != F.col("_b")) & F.contains("_a", F.col("_b")))
    earlier = cut_lineage(pairs.select(unit, F.least("_a", "_b").alias("_early"), F.greatest("_a", "_b").alias(name)).distinct())
    opens = own.join(earlier.select(unit, name).distinct(), [unit, name], "left_anti")
    # the names whose label fell in the last round hand it on; labels of names that have none yet count as none
    labels = cut_lineage(opens.withColumn("cluster", F.col(name)))
    fallen = labels
    while not fallen.isEmpty():
        handed = fallen.withColumnRenamed(name, "_early").join(earlier, [unit, "_early"]).groupBy(unit, name).agg(F.min("cluster").alias("_new"))
        fallen = cut_lineage(handed.join(labels, [unit, name], "left").filter(F.col("cluster").isNull() | (F.col("_new") < F.col("cluster"))).select(unit, name, F.col("_new").alias("cluster")))
        labels = cut_lineage(labels.join(fallen.select(unit, name), [unit, name], "left_anti").unionByName(fallen))
    return labels


def reconciled(rows: DataFrame, unit: str, name: str, kind: str, kinds: list[str], qty: str) -> DataFrame:
    """Clusters of names with their quantities of each kind of source side by side: unit, cluster, name (the longest, then first),
    names, a column a kind, status."""
    found = rows.join(name_clusters(rows, unit, name), [unit, name])
    titles = found.groupBy(unit, "cluster").agg(F.min(F.struct((-F.length(name)).alias("n"), F.col(name).alias("name")))["name"].alias("name"), F.count_distinct(name).alias("names"))
    return reconcile(found, [unit, "cluster"], kind, kinds, qty).join(titles, [unit, "cluster"])


def header_rows(cells: DataFrame, most: int = 20) -> DataFrame:
    """sheet, header of cells (sheet, r, value): the first of a sheet's first most filled rows that has two or more cells, all
    text, and a number in the filled row below it."""
    number = F.regexp_like(F.trim("value"), F.lit(r"^[+-]?[0-9]+([.,][0-9]+)?$"))
    rows = cells.filter(F.trim("value") != "").groupBy("sheet", "r").agg(F.count(F.lit(1)).alias("n"), F.count_if(number).alias("numbers"))
    order = Window.partitionBy("sheet").orderBy("r")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("below", F.lead("numbers").over(order))
    return rows.filter((F.col("nth") <= most) & (F.col("n") >= 2) & (F.col("numbers") == 0) & (F.col("below") > 0)).groupBy("sheet").agg(F.min("r").alias("header"))


def row_text(fields: dict[str, Column], limit: int) -> Column:
    """A table row as "label: value" parts without nulls and blanks, in the order of fields, cut to limit characters."""
    parts = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{k}: "), F.trim(v.cast("string")))) for k, v in fields.items()]
    return F.substring(F.concat_ws("; ", *parts), 1, limit)

"""URL filter: a path-template tree per host, judged by labelled purity. DataFrame functions only.

1. Segments that are variable by their form (numbers, dates, hexadecimal or long ids, mixed letters and digits) become
   ``*``, keeping a file extension. Pages are aggregated to their (host, shape), labelled by the rules that fit them.
2. The tree of a host is walked level by level: children of a node that are many and each rare become ``*``; children
   whose labelled block rate doesn't differ significantly from their siblings' pooled rate are merged with them. A node
   below is reached by its merged path, so similar branches share one template.
3. A template's block rate, smoothed towards its host's and that towards the whole corpus's, is its impurity; templates
   above the threshold are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, UPPER, heavy_keys, materialize, skew_join

#: Rules (host, path, verdict) that the query judges by: a rule fits its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Tree:
    depth: int = 4  #: levels with segments of their own; what lies deeper is one last segment
    fan: int = 24  #: a node with more children than this has a variable segment there, if
    share: float = 0.5  #: children of fewer than so many times the mean count hold most of its pages
    z: float = 1.96  #: children whose block rate is within so many standard errors of the pooled rate are merged
    prior: float = 4.0  #: labelled pages that the parent's rate weighs
    reject: float = 0.5  #: block rate from which a template is rejected


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end; then up to ``?``, ``#`` or the end. Null or no ``://``: empty."""
    rest = F.expr("substring({0}, locate('://', {0}) + 3)".format("_url"))
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict: the longest fitting rule (host + path) of a short list; null where none fits."""
    host, path = split_url(F.col("_url"))
    rows = pages.select(F.col("page_id"), F.col("url").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=False):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def shape(path: Column, depth: int) -> Column:
    """The path's segments with those of variable form as ``*``, at most depth and one for the rest."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    stem = r"^(?:\d+|[0-9a-fA-F]{8,}|(?=[^.]*\d)(?=[^.]*[A-Za-z])[\w-]+|\d[\d._-]*|[^.]{40,})(\.[A-Za-z]{1,5})?$"
    marked = F.transform(segments, lambda s: F.when(s.rlike(stem), F.concat(F.lit("*"), F.regexp_extract(s, stem, 1))).otherwise(s))
    deep = F.size(marked) > depth
    return F.when(deep, F.concat(F.slice(marked, 1, depth), F.array(F.lit("**")))).otherwise(marked)


def templates(rows: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """From ruled() rows with their shape: host, shape, template, impurity, verdict."""
    labelled = F.col("rule_verdict").isNotNull()
    counted = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(labelled, 1).otherwise(0)).alias("labelled"), F.sum(F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("blocked")
    )
    nodes = materialize(counted.withColumn("template", F.lit("")))
    hot = heavy_keys(nodes, "host", nodes.count())  # hosts of very many shapes are dealt over salts in every join
    for level in range(tree.depth + 1):
        at = nodes.withColumn("segment", F.get(F.col("shape"), F.lit(level)))
        children = at.filter("segment is not null").groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
        parent = children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.sum(F.when(F.col("labelled") > 0, 1).otherwise(0)).alias("known")
        )
        rate = F.try_divide("all_blocked", "all_labelled")
        error = F.sqrt(F.try_divide(rate * (1 - rate), F.col("labelled")))
        variable = (F.col("kinds") > tree.fan) & (F.col("n") < tree.share * F.col("all_n") / F.col("kinds") + 1)
        similar = (F.col("known") > 1) & (F.col("labelled") > 0) & (F.abs(F.try_divide("blocked", "labelled") - rate) <= tree.z * error)
        named = skew_join(children, parent, ["host", "template"], hot, F.col("segment")).select("host", "template", "segment", F.when(variable | similar, F.lit("*")).otherwise(F.col("segment")).alias("name"))
        path = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))
        put = skew_join(at, named, ["host", "template", "segment"], hot, F.col("shape"))
        nodes = materialize(put.select("host", "shape", "n", "labelled", "blocked", path.alias("template")))
    by_template = nodes.groupBy("host", "template").agg(F.sum("labelled").alias("t_labelled"), F.sum("blocked").alias("t_blocked"))
    by_host = nodes.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("blocked").alias("h_blocked"))
    corpus = nodes.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("corpus"))
    host_rate = (F.col("h_blocked") + tree.prior * F.col("corpus")) / (F.col("h_labelled") + tree.prior)
    impurity = (F.col("t_blocked") + tree.prior * host_rate) / (F.col("t_labelled") + tree.prior)
    judged = skew_join(by_template, by_host, "host", hot, F.col("template")).join(F.broadcast(corpus)).withColumn("impurity", impurity)
    verdict = F.when(F.col("impurity") > tree.reject, "block").otherwise("allow")
    return skew_join(nodes, judged, ["host", "template"], hot, F.col("shape")).select("host", "shape", "template", "impurity", verdict.alias("verdict"))


def judge(pages: DataFrame, rules=RULES, tree: Tree = Tree()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, impurity for every row of pages (page_id, url).

    verdict: the longest rule's, else the template's. Null urls and those without ``://`` have an empty host and path and
    are judged like any other; a path without segments has the template ''. Repeated rows are judged one by one; without
    labels every template has the rate 1/2 and is allowed; an empty table gives no rows; other columns are ignored.
    """
    rows = ruled(pages, rules).withColumn("shape", shape(F.col("path"), tree.depth))
    found = templates(rows, tree)
    # shapes are few where pages are many: page rows of a hot shape are dealt over salts
    hot = heavy_keys(rows, ["host", "shape"], pages.count())
    table = found.select("host", "shape", "template", "impurity", F.col("verdict").alias("_verdict"))
    out = skew_join(rows, table, ["host", "shape"], hot, F.struct("page_id", "path"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "_verdict").alias("verdict"), "template", "impurity")


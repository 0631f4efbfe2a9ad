"""Queries over heading trees of pages, their scopes and searches within them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import hierarchy as H, postings
from tessella.plans.base import kept, query, table
from tessella.plans.corpus import TERMS, TOK

#: Pages as marked text: a title is a heading of level 1, h1 of level 2, a bold line of level 3; blocks are blank lines apart.
_MARKS = (
    (r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), (r"<title[^>]*>", "\n# "), (r"<h1[^>]*>", "\n## "), (r"<h[2-6][^>]*>|<b>", "\n### "),
    (r"</?(title|h[1-6]|b|p|li|ul|ol|tr|div|nav|br)[^>]*>", "\n"), (r"<[^>]*>", ""), (r"\n{2,}", "\n\n"),
)


def page_chunks(pages: DataFrame) -> DataFrame:
    """doc_id, ord, text: the blocks of pages."""
    text = F.col("html")
    for pattern, put in _MARKS:
        text = F.regexp_replace(text, pattern, put)
    return pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(text, "\n\n")).alias("ord", "text")).filter("length(text) > 0")


def _tree(pages: DataFrame, path: str) -> str:
    return H.write(page_chunks(pages), path, in_order=True)


def _numbered(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(H.number(F.col("doc_id"), F.col("ord")).alias("doc_id"), F.col(text).alias("text"))


def trees(spark, d) -> str:
    """The pages' heading trees; the postings of their chunks and titles are stores of their own, built by who searches them."""
    return kept(spark, d, "pages", _tree)


def chunk_postings(spark, d) -> str:
    return kept(spark, d, "pages", lambda pages, path: postings.build(_numbered(page_chunks(pages), "text"), path))


def title_postings(spark, d) -> str:
    tree = trees(spark, d)
    return kept(spark, d, "pages", lambda pages, path: postings.build(_numbered(H.read(spark, tree)[0], "title"), path))


def unnumbered(rows: DataFrame) -> DataFrame:
    """page_id, ord, score of a search's rows."""
    return rows.select(F.shiftright("doc", 24).alias("page_id"), (F.col("doc") % H.CHUNKS).cast("int").alias("ord"), F.round("score", 6).alias("score"))


def _put(pattern: str, put: str, text: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{put}', 'g')"


def _text_sql() -> str:
    text = "html"
    for pattern, put in _MARKS:
        text = _put(pattern.replace("'", "''"), put.replace("\n", "' || chr(10) || '"), text)
    return text


_TRIM = r"regexp_replace({0}, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')".replace("{0b}", "{{0b}}").replace("{1c}", "{{1c}}").replace("{1f}", "{{1f}}").replace("{85}", "{{85}}").replace("{Z}", "{{Z}}")
_MD, _NUM = r"^(#{1,6})[\s\x{1c}-\x{1f}]+(.{2,160})$", r"^(\d+(?:\.\d+){0,4})[.\s\x{1c}-\x{1f}]+([А-ЯЁA-Z].{1,150})$"
_ENDS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_ID = "substr(sha256(doc_id || ':section:' || array_to_string(list_transform({0}, lambda t: length(t) || ':' || t), '')), 1, 32)"

#: k: chunks; o: those that open a heading; t: their paths, by recursion from each heading to the nearest earlier one of a lower
#: level; n: navigation nodes; e: chunks with the ids of the headings over them.
TREE = rf"""m AS (SELECT page_id AS doc_id, {_text_sql()} AS text FROM pages),
  k AS (SELECT * FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1)::INTEGER - 1 AS ord, unnest(string_split(text, chr(10) || chr(10))) AS text FROM m) WHERE length(text) > 0),
  l AS (SELECT doc_id, ord, list_filter(list_transform(regexp_split_to_array(text, '{_ENDS}')[1:6], lambda v: {_TRIM.format("v")}), lambda v: v <> '') AS lines FROM k),
  q AS (SELECT doc_id, ord, list_filter(list_transform(lines, lambda v: CASE WHEN regexp_matches(v, '{_MD}') THEN {{'title': {_TRIM.format(f"regexp_extract(v, '{_MD}', 2)")}, 'level': length(regexp_extract(v, '{_MD}', 1))}}
      WHEN regexp_matches(v, '{_NUM}') THEN {{'title': regexp_extract(v, '{_NUM}', 1) || ' ' || {_TRIM.format(f"regexp_extract(v, '{_NUM}', 2)")}, 'level': length(regexp_extract(v, '{_NUM}', 1)) - length(replace(regexp_extract(v, '{_NUM}', 1), '.', '')) + 1}} END), lambda x: x IS NOT NULL)[1] AS own FROM l),
  o AS (SELECT doc_id, ord, own.title AS title, own.level::INTEGER AS level FROM q WHERE own IS NOT NULL),
  p AS (SELECT a.doc_id, a.ord, max(b.ord) AS up FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level GROUP BY ALL),
  t AS (SELECT doc_id, ord, title, level, [title] AS titles, [{_ID.format("[title]")}] AS ids FROM o JOIN p USING (doc_id, ord) WHERE up IS NULL
    UNION ALL SELECT o.doc_id, o.ord, o.title, o.level, list_append(t.titles, o.title), list_append(t.ids, {_ID.format("list_append(t.titles, o.title)").replace("doc_id ||", "o.doc_id ||")}) FROM p JOIN t ON t.doc_id = p.doc_id AND t.ord = p.up JOIN o ON o.doc_id = p.doc_id AND o.ord = p.ord),
  n AS (SELECT doc_id, ids[-1] AS node_id, ord, title, level, len(ids)::INTEGER AS depth, ids[-2] AS parent_id FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, ids[-1] ORDER BY ord) = 1),
  e AS (SELECT k.doc_id, k.ord, k.text, x.ord AS opened, x.title, x.level, coalesce(x.ids, []) AS ids FROM k ASOF LEFT JOIN t x ON x.doc_id = k.doc_id AND x.ord <= k.ord)"""


@query(f"""WITH RECURSIVE {TREE} SELECT doc_id AS page_id, node_id, ord, title, level, depth, parent_id, (SELECT count(*) FROM e WHERE e.doc_id = n.doc_id AND list_contains(ids, node_id)) AS chunks FROM n""")
def heading_tree(spark, d):
    """Every heading of every page with its parent and the number of chunks under it, by the scope index."""
    nodes, _, scopes = H.read(spark, trees(spark, d))
    under = scopes.groupBy(F.col("ancestor").alias("node_id")).agg(F.count(F.lit(1)).alias("chunks"))
    return nodes.join(under, "node_id").select(F.col("doc_id").alias("page_id"), "node_id", "ord", "title", "level", "depth", "parent_id", "chunks")


@query(rf"""WITH RECURSIVE {TREE} SELECT doc_id AS page_id, ord, substr(sha256(doc_id || ':chunk:' || length(ord::VARCHAR) || ':' || ord || '40:' || sha1(text)), 1, 32) AS node_id, level,
  coalesce(title, list_filter(list_transform(regexp_split_to_array(text, '{_ENDS}'), lambda v: regexp_replace(v, '^[ #\t]+|[ #\t]+$', '', 'g')), lambda v: length(v) BETWEEN 4 AND 160)[1], '') AS heading, coalesce(opened < ord, false) AS inherited, ids[-1] AS scope, len(ids)::INTEGER AS depth FROM e""")
def chunk_scopes(spark, d):
    """Every chunk's heading, own or inherited, and the innermost node over it."""
    rows = H.read(spark, trees(spark, d))[1]
    return rows.select(F.col("doc_id").alias("page_id"), "ord", "node_id", "level", "heading", "inherited", F.try_element_at("ancestors", F.lit(-1)).alias("scope"), F.size("ancestors").alias("depth"))


def _scores_sql(rows: str, where: str = "TRUE") -> str:
    """Scores of rows (doc_id, ord, text); where says which of them are found, of all that weigh."""
    terms = ", ".join(f"('{t}')" for t in TERMS)
    return f"""(WITH w AS (SELECT doc_id, ord, {TOK.format("text")} AS w FROM {rows}), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
      f AS (SELECT doc_id, ord, term, len(w) AS len, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (VALUES {terms}) v(term)), h AS (SELECT term, count(*) AS df FROM f WHERE tf > 0 GROUP BY term)
      SELECT doc_id, ord, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM f JOIN h USING (term), s WHERE tf > 0 AND {where} GROUP BY doc_id, ord)"""


_TITLES = "(SELECT doc_id, ord, title AS text FROM n)"
#: Titles of scopes.
_SCOPE = "level = 2 AND contains(lower(title), 'and')"


@query(f"""WITH RECURSIVE {TREE}, g AS (SELECT node_id FROM n WHERE {_SCOPE}), b AS (SELECT doc_id, ord FROM e WHERE len(list_filter(ids, lambda i: i IN (SELECT node_id FROM g))) > 0)
  SELECT doc_id AS page_id, ord, round(score, 6) AS score FROM {_scores_sql("k", "(doc_id, ord) IN (SELECT (doc_id, ord) FROM b)")} ORDER BY 3 DESC, doc_id, ord LIMIT 20""".replace("len(list_filter(ids, lambda i: i IN (SELECT node_id FROM g))) > 0", "list_has_any(ids, (SELECT coalesce(list(node_id), []) FROM g))"))
def bm25_scoped(spark, d):
    """The best chunks under headings of level 2 that hold a word: terms weigh as in all chunks."""
    path = trees(spark, d)
    nodes = H.read(spark, path)[0].filter(F.expr(_SCOPE))
    scope = H.below(spark, path, nodes).select(H.number(F.col("doc_id"), F.col("ord")).alias("doc"))
    best = postings.scores(spark, chunk_postings(spark, d), TERMS, scope).withColumn("score", F.round("score", 6))
    return unnumbered(best.orderBy(F.desc("score"), "doc").limit(20))


@query(f"""WITH RECURSIVE {TREE}, a AS (SELECT doc_id, ord FROM {_scores_sql(_TITLES)} ORDER BY score DESC, doc_id, ord LIMIT 4), i AS (SELECT list(node_id) AS own FROM n JOIN a USING (doc_id, ord)),
  c AS MATERIALIZED (FROM {_scores_sql("k")}), x AS (SELECT c.doc_id, c.ord, score FROM c JOIN e USING (doc_id, ord), i WHERE list_has_any(ids, own) ORDER BY score DESC, c.doc_id, c.ord LIMIT 8)
  SELECT doc_id AS page_id, ord, round(score, 6) AS score, 'evidence' AS leg FROM (FROM c ORDER BY score DESC, doc_id, ord LIMIT 8) UNION ALL SELECT doc_id, ord, round(score, 6), 'descendant' FROM x""")
def hierarchical_search(spark, d):
    """Eight chunks found themselves, and as a pool of its own eight found under the four best headings."""
    path = trees(spark, d)
    own = unnumbered(postings.search(spark, chunk_postings(spark, d), TERMS, 8)).withColumn("leg", F.lit("evidence"))
    titles = postings.search(spark, title_postings(spark, d), TERMS, max(4, min(8 // 2, 16)))
    nodes = H.read(spark, path)[0].withColumn("doc", H.number(F.col("doc_id"), F.col("ord"))).join(F.broadcast(titles), "doc", "left_semi")  # four titles
    scope = H.below(spark, path, nodes).select(H.number(F.col("doc_id"), F.col("ord")).alias("doc"))
    return own.union(unnumbered(postings.search(spark, chunk_postings(spark, d), TERMS, 8, scope)).withColumn("leg", F.lit("descendant")))


@query(f"""WITH RECURSIVE {TREE}, a AS (SELECT doc_id, ord, row_number() OVER (ORDER BY score DESC, doc_id, ord) AS route FROM {_scores_sql(_TITLES)} QUALIFY route <= 8),
  f AS (SELECT e.doc_id, e.ord, min(route)::INTEGER AS route FROM a JOIN n USING (doc_id, ord) JOIN e ON e.doc_id = n.doc_id AND list_contains(e.ids, n.node_id) GROUP BY ALL)
  SELECT doc_id AS page_id, ord, route, round(1.0 / (60 + route), 6) AS score FROM f ORDER BY route, doc_id, ord LIMIT 32""")
def summary_routes(spark, d):
    """Leaves under the eight best headings in order: a leaf's first route wins, 32 leaves are read."""
    path = trees(spark, d)
    titles = postings.search(spark, title_postings(spark, d), TERMS, 8).withColumn("route", F.row_number().over(Window.orderBy(F.desc("score"), "doc"))).select("doc", "route")
    nodes = H.read(spark, path)[0].withColumn("doc", H.number(F.col("doc_id"), F.col("ord"))).join(F.broadcast(titles), "doc").select("node_id", "route")  # eight titles
    leaves = H.below(spark, path, nodes).join(F.broadcast(nodes.withColumnRenamed("node_id", "ancestor")), "ancestor")
    first = leaves.groupBy("doc_id", "ord").agg(F.min("route").alias("route")).orderBy("route", "doc_id", "ord").limit(32)
    return first.select(F.col("doc_id").alias("page_id"), "ord", "route", F.round(1.0 / (60 + F.col("route")), 6).alias("score"))

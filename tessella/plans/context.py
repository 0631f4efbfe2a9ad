"""Queries over reading units, placed and packed evidence, routes, promotions and scopes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import reading as R, typed as T
from tessella.plans.base import kept, query, table
from tessella.plans.corpus import CHUNKS, chunks

#: Pages as Markdown: title and headings marked, other blocks as lines, scripts and styles left out.
_MARKS = ((r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), (r"<(title|h1)[^>]*>", "\n# "), (r"<h[2-6][^>]*>", "\n## "), (r"</?(title|h[1-6]|p|li|ul|ol|tr|div|nav|br)[^>]*>", "\n"), (r"<[^>]*>", ""), (r"\n{2,}", "\n\n"))


def _markdown(spark, d):
    text = F.col("html")
    for pattern, put in _MARKS:
        text = F.regexp_replace(text, pattern, put)
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), text.alias("text"))


@query()
def reading_units(spark, d):
    """Units of 600 characters of pages as Markdown; headings that the next unit repeats aren't units of their own."""
    return R.units_for_index(R.reading_units(_markdown(spark, d), 600))


@query()
def structured_chunks(spark, d):
    """Chunks of 1,000 characters of documents by clause, sentence and slice, with an overlap of 100."""
    return R.chunk_structured(table(spark, d, "documents"), 1000, 100)


@query("""SELECT p_partkey, '| ' || replace(p_name, ' ', '\\|') || ' | ' || p_type || ' | ' || p_size || ' |' AS line, replace(p_name, ' ', '|') AS first_cell, 3 AS cells FROM part""".replace("\\\\", "\\"))
def table_cells(spark, d):
    """Parts as Markdown rows whose first cell holds bars, and the cells read back."""
    fields = F.array(F.replace("p_name", F.lit(" "), F.lit("|")), F.col("p_type"), F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", R.escaped_row(fields).alias("line")).withColumn("c", R.row_cells(F.col("line")))
    return rows.select("p_partkey", "line", F.col("c")[0].alias("first_cell"), F.size("c").alias("cells"))


@query("""SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id OFFSET 40 LIMIT 100""")
def paged_rows(spark, d):
    """A page of a stored table in order of its key, with the number of all rows: its files alone are read."""
    root = kept(spark, d, "documents", _rows_by_id)
    return T.page(spark, root, 40, 100).select("doc_id", "source", "n_chars", F.col("_total").alias("total"))


def _rows_by_id(docs, path):
    T.write(docs.select("doc_id", "source", "n_chars"), path, ["doc_id"])
    return path


@query("""WITH g AS (SELECT doc_id, source FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)), p AS (SELECT DISTINCT source AS project FROM documents WHERE source IS NOT NULL)
  SELECT project, doc_id FROM p JOIN g ON g.source IN ('src0', project) QUALIFY row_number() OVER (PARTITION BY project ORDER BY doc_id DESC) <= 5""")
def notes_projection(spark, d):
    """The five newest enabled notes of every project, among its own and the common ones (those of src0)."""
    docs = table(spark, d, "documents").select("doc_id", "source").filter("source IS NOT NULL")
    good = docs.join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    common = [r["doc_id"] for r in good.filter("source = 'src0'").orderBy(F.desc("doc_id")).limit(5).collect()]
    shared = docs.filter("source <> 'src0'").select(F.col("source").alias("project")).distinct().select("project", F.explode(F.array(*map(F.lit, common)).cast("array<bigint>")).alias("doc_id"))
    rows = good.select(F.col("source").alias("project"), "doc_id").union(shared)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("doc_id")))).filter("n <= 5").select("project", "doc_id")


@query(rf"""WITH c AS (SELECT doc_id, ord, chunk, doc_id || '|' || sha1(trim(regexp_replace(chunk, '\s+', ' ', 'g'))) AS key, length(chunk) - length(replace(chunk, ',', '')) AS marks FROM {CHUNKS} WHERE length(chunk) > 0),
  b AS (SELECT key, row_number() OVER (ORDER BY doc_id, ord) AS position FROM (SELECT key, min(doc_id) AS doc_id, min(ord) AS ord FROM c GROUP BY key) ORDER BY doc_id, ord LIMIT 30), t AS (SELECT key, row_number() OVER (ORDER BY marks DESC, doc_id, ord) AS nth FROM (SELECT key, max(marks) AS marks, min(doc_id) AS doc_id, min(ord) AS ord FROM c WHERE marks >= 4 GROUP BY key) ORDER BY marks DESC, doc_id, ord LIMIT 8),
  m AS (SELECT key, position, nth, row_number() OVER (ORDER BY position IS NULL, position, nth) AS place FROM b FULL JOIN t USING (key)), s AS (SELECT *, coalesce(nth IS NOT NULL AND min(CASE WHEN nth IS NOT NULL THEN place END) OVER () > 12 AND row_number() OVER (PARTITION BY nth IS NOT NULL ORDER BY nth, place) <= 2, false) AS up FROM m),
  u AS (SELECT *, count(*) FILTER (up) OVER () AS ups, row_number() OVER (PARTITION BY up ORDER BY CASE WHEN up THEN nth END, place) AS n FROM s)
  SELECT key, position, nth, (row_number() OVER (ORDER BY CASE WHEN up THEN 1 WHEN n <= 12 - ups THEN 0 ELSE 2 END, n)) AS final FROM u""")
def table_appendix(spark, d):
    """The first thirty passages and the eight that look most like tables (here: by commas), of which two come into view."""
    key = F.concat_ws("|", "doc_id", F.sha1(F.trim(F.regexp_replace("chunk", r"\s+", " "))))
    rows = chunks(spark, d).filter(F.length("chunk") > 0).select("doc_id", "ord", key.alias("key"), (F.length("chunk") - F.length(F.replace("chunk", F.lit(","), F.lit("")))).alias("marks"))
    once = rows.groupBy("key").agg(F.max("marks").alias("marks"), F.min("doc_id").alias("doc_id"), F.min("ord").alias("ord"))
    number = lambda order: F.row_number().over(Window.orderBy(*order))
    first, dense = ["doc_id", "ord"], [F.desc("marks"), "doc_id", "ord"]
    base = once.orderBy(*first).limit(30).withColumn("position", number(first)).select("key", "position")
    tables = once.filter("marks >= 4").orderBy(*dense).limit(8).withColumn("nth", number(dense)).select("key", "nth")
    return R.with_appendix(base, tables, ["key"], 12, 2)


_TOPIC = ["of the", "is", "und", "ment", "par sur"]


def _topic_pattern(term: str) -> str:
    """A term at a word's beginning; one of up to three characters is a whole word."""
    return r"(^|[^\p{L}\p{N}_])" + term + (r"([^\p{L}\p{N}_]|$)" if len(term) <= 3 else "")


def _points(term: str) -> int:
    return 8 if " " in term else 5


@query("SELECT lang, doc_id, score FROM (SELECT lang, doc_id, " + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{_topic_pattern(t)}') THEN {_points(t)} ELSE 0 END" for t in _TOPIC) + """ AS score FROM documents) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) <= 12""")
def topic_matches(spark, d):
    """The twelve documents of every language that match a topic's terms best."""
    low = F.lower("text")
    score = sum((F.when(low.rlike(_topic_pattern(t)), _points(t)).otherwise(0) for t in _TOPIC), F.lit(0))
    rows = table(spark, d, "documents").select("lang", "doc_id", score.alias("score")).filter("score > 0")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))).filter("n <= 12").drop("n")


_CARD = {"p_type": 20, "p_brand": 4, "p_name": 2}
_ASKED, _ASKED_TERMS = "small", ["small", "brand#1", "eco", "widget"]


@query(f"""SELECT * FROM (SELECT p_partkey, CASE WHEN contains(lower(concat_ws(' ', p_type, p_brand, p_name)), '{_ASKED}') THEN 12 ELSE 0 END + """ + " + ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN {n} ELSE 0 END" for c, n in _CARD.items() for t in _ASKED_TERMS) + """ AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 40""")
def table_cards(spark, d):
    """Tables' cards by where a question and its terms are met: the kind counts 20, headers 4, a sample 2, the whole question 12."""
    has = lambda c, t, n: F.when(F.contains(F.lower(c), F.lit(t)), n).otherwise(0)
    score = sum((has(F.col(c), t, n) for c, n in _CARD.items() for t in _ASKED_TERMS), has(F.concat_ws(" ", *_CARD), _ASKED, 12))
    return table(spark, d, "part").select("p_partkey", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(40)


#: Rules in the order in which they are applied: terms, points in the name, points in the text, fewest terms that count.
_PROMOTE = ((["their", "of the"], 4, 2, 1), (["src1"], 4, 3, 1), (["src2"], 8, 2, 1), (["with", "from"], 1, 1, 2))


def _rule_sql(terms, name, body, least) -> str:
    points = " + ".join(f"CASE WHEN contains(lower(source), '{t}') THEN {name} WHEN contains(lower(text), '{t}') THEN {body} ELSE 0 END" for t in terms)
    return f"CASE WHEN {points} >= {least} THEN {points} ELSE 0 END"


@query(f"""WITH p AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS was FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50), s AS (SELECT doc_id, was, {", ".join(f"{_rule_sql(*r)} AS s{k}" for k, r in enumerate(_PROMOTE))} FROM p)
  SELECT doc_id, was::INTEGER AS was, (row_number() OVER (ORDER BY s3 DESC, s2 DESC, s1 DESC, s0 DESC, was))::INTEGER AS place FROM s""")
def promoted_matches(spark, d):
    """Fifty found documents after stable promotions by source, identifier, named standard and source name: the last rule leads."""
    found = table(spark, d, "documents").select("doc_id", "source", "text", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    found = found.withColumn("was", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))

    def score(terms, name, body, least):
        points = sum((F.when(F.contains(F.lower("source"), F.lit(t)), name).when(F.contains(F.lower("text"), F.lit(t)), body).otherwise(0) for t in terms), F.lit(0))
        return F.when(points >= least, points).otherwise(0)

    order = [F.desc(F.coalesce(score(*rule), F.lit(0))) for rule in reversed(_PROMOTE)]
    return found.select("doc_id", "was", F.row_number().over(Window.orderBy(*order, "was")).alias("place"))


@query(f"""WITH c AS (SELECT source, doc_id, ord, length(chunk) AS size, doc_id // 4 AS parent FROM {CHUNKS} WHERE source IS NOT NULL), a AS (SELECT source, doc_id, ord, parent, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id, ord) AS position FROM c QUALIFY position <= 20),
  e AS (SELECT DISTINCT a.source, c.doc_id, c.ord FROM a JOIN c ON c.parent = a.parent AND c.ord = a.ord ANTI JOIN a b ON b.source = a.source AND b.doc_id = c.doc_id AND b.ord = c.ord),
  p AS (SELECT source, doc_id, ord, position, true AS anchor FROM a UNION ALL SELECT source, doc_id, ord, 20 + row_number() OVER (PARTITION BY source ORDER BY doc_id, ord), false FROM e),
  f AS (SELECT *, min(position) OVER (PARTITION BY source, doc_id) AS first, bool_or(anchor) OVER (PARTITION BY source, doc_id) AS own FROM p), n AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY first) AS nth FROM f) SELECT source, doc_id, ord, anchor FROM n WHERE nth <= 24 OR own""")
def read_plans(spark, d):
    """What is read for every source's twenty longest lines and the lines beside them in documents of one parent: 24 documents
    at most, and all those of the anchors."""
    rows = chunks(spark, d).filter("source IS NOT NULL").select("source", "doc_id", "ord", F.length("chunk").alias("size"), F.floor(F.col("doc_id") / 4).alias("parent"))
    a = rows.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), "doc_id", "ord"))).filter("position <= 20")
    near = a.select("source", "parent", "ord").distinct().join(rows.drop("source", "size"), ["parent", "ord"]).join(a, ["source", "doc_id", "ord"], "left_anti")
    e = near.select("source", "doc_id", "ord").distinct().withColumn("position", 20 + F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "ord")))
    pool = a.select("source", "doc_id", "ord", "position", F.lit(True).alias("anchor")).union(e.select("source", "doc_id", "ord", "position", F.lit(False).alias("anchor")))
    return R.read_plan(pool, "source", ["doc_id"], 24).select("source", "doc_id", "ord", "anchor")


@query("""WITH l AS (SELECT l_orderkey AS sheet, l_partkey % 2 AS book, l_suppkey % 5 AS row, l_extendedprice AS price FROM lineitem), o AS (SELECT sheet FROM l GROUP BY sheet HAVING count(DISTINCT book) = 1), s AS (SELECT sheet, row FROM l GROUP BY sheet, row HAVING count(*) = 1),
  a AS (SELECT * FROM l SEMI JOIN o USING (sheet) SEMI JOIN s USING (sheet, row)), r AS (SELECT * FROM l WHERE price > 50000) SELECT *, true AS addressed FROM a UNION ALL SELECT *, false FROM r ANTI JOIN a USING (sheet, row)""")
def addressed_rows(spark, d):
    """Rows named by sheet and number where one book owns the sheet and one reading is known; other rows follow."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.col("l_partkey") % 2).alias("book"), (F.col("l_suppkey") % 5).alias("row"), F.col("l_extendedprice").alias("price"))
    found = R.addressed(lines, ["sheet"], "book", "row")
    rest = lines.filter("price > 50000").join(found, ["sheet", "row"], "left_anti").select("sheet", "book", "row", "price")
    return found.select("sheet", "book", "row", "price", F.lit(True).alias("addressed")).union(rest.withColumn("addressed", F.lit(False)))


_FAMILY = f"""c AS (SELECT source, doc_id, ord, length(chunk) AS size, row_number() OVER (PARTITION BY source ORDER BY length(chunk) DESC, doc_id, ord) AS rank FROM {CHUNKS} WHERE source IS NOT NULL AND length(chunk) > 0 QUALIFY rank <= 64),
  f AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY rank) AS nth FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY nth > 1, rank) AS position FROM f)"""


@query(f"""WITH RECURSIVE {_FAMILY}, r AS (SELECT source, 0::BIGINT AS position, NULL::VARCHAR AS unit, 0::BIGINT AS took, 0::BIGINT AS total FROM (SELECT DISTINCT source FROM o)
    UNION ALL SELECT source, position, unit, took, total + CASE WHEN took > 0 THEN took + gap ELSE 0 END FROM (SELECT *, CASE WHEN size <= room THEN size WHEN room > 80 THEN room ELSE 0 END AS took FROM (SELECT o.source, o.position, o.doc_id || '.' || o.ord AS unit, size, total, CASE WHEN total > 0 THEN 2 ELSE 0 END AS gap, 4000 - total - gap AS room FROM r JOIN o ON o.source = r.source AND o.position = r.position + 1)))
  SELECT source, position::INTEGER AS position, unit, took FROM r WHERE took > 0""")
def packed_contexts(spark, d):
    """Four thousand characters of every source's 64 longest lines: one of each document first, long ones cut to the room left."""
    by = Window.partitionBy("source").orderBy(F.desc("size"), "doc_id", "ord")
    rows = chunks(spark, d).filter("source IS NOT NULL AND length(chunk) > 0").select("source", "doc_id", "ord", F.length("chunk").alias("size")).withColumn("rank", F.row_number().over(by)).filter("rank <= 64")
    nth = F.row_number().over(Window.partitionBy("source", "doc_id").orderBy("rank"))
    position = F.row_number().over(Window.partitionBy("source").orderBy(F.col("nth") > 1, "rank"))
    found = rows.withColumn("nth", nth).withColumn("position", position).withColumn("unit", F.concat_ws(".", "doc_id", "ord"))
    return R.packed_context(found, "source", 4000)


@query("""SELECT o_orderkey AS message, o_custkey AS folder, o_orderstatus <> 'O' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS is_current FROM orders""")
def mail_locations(spark, d):
    """Messages of the folders that were read anew (status O) are current only if the new listing has them; none is deleted."""
    listed = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("message")).distinct().withColumn("listed", F.lit(True))
    held = table(spark, d, "orders").select(F.col("o_orderkey").alias("message"), F.col("o_custkey").alias("folder"), "o_orderstatus").join(listed, "message", "left")
    return held.select("message", "folder", ((F.col("o_orderstatus") != "O") | F.coalesce("listed", F.lit(False))).alias("is_current"))


@query("""SELECT event_id, 'T' || user_id AS sheet, array_to_string(list_sort(list_distinct(list_concat(range(event_id % 40 + 1, event_id % 40 + 4), [user_id % 90 + 1]))), ',') AS rows FROM events""")
def sheet_addresses(spark, d):
    """Rows of a sheet that a question names, ranges and lists alike."""
    first = F.col("event_id") % 40 + 1
    question = F.concat(F.lit('Sum 7 of sheet "T'), F.col("user_id").cast("string"), F.lit('", rows '), first.cast("string"), F.lit(" - "), (first + 2).cast("string"), F.lit(" and "), (F.col("user_id") % 90 + 1).cast("string"), F.lit("?"))
    rows = table(spark, d, "events").select("event_id", X.sheet_rows(question).alias("a"))
    return rows.select("event_id", "a.sheet", F.array_join(F.col("a.rows").cast("array<string>"), ",").alias("rows"))

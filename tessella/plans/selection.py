"""Queries that choose what is read: sections under a budget, topics' files, nested candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import fusion, reading as R, selection as S
from tessella.operators.catalog import cut_lineage
from tessella.plans.base import query, table
from tessella.plans.context import _TOPIC, _points, _topic_pattern
from tessella.plans.corpus import CHANNELS, CHUNKS, TERMS, TOK, bm25_sql, channels, chunks, scored

#: Tokens that a source's sections may have.
_ROOM = 1500

_OBJECTS = f"""SELECT source, doc_id || '.' || ord AS id, length(chunk) // 4 + 1 AS tokens, (doc_id % 3)::INTEGER AS kind, row_number() OVER (PARTITION BY source ORDER BY length(chunk) DESC, doc_id, ord) AS position
    FROM {CHUNKS} WHERE source IS NOT NULL AND length(chunk) > 0 QUALIFY position <= 40"""


@query(f"""WITH RECURSIVE o AS ({_OBJECTS}), s AS (SELECT source, kind, position, id, position > CASE WHEN source = 'src3' THEN 12 ELSE 2 END AS optional, unnest([0, 1, 2]) AS part, unnest([tokens, tokens // 3 + 1, tokens // 5 + 1]) AS tokens FROM o),
  n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY optional, kind, position, part) AS step FROM s WHERE optional OR part = 0), m AS (SELECT source, sum(tokens + 1) FILTER (NOT optional) - 1 > {_ROOM} AS overflow FROM n GROUP BY source),
  r AS (SELECT source, 0::BIGINT AS step, 0::HUGEINT AS used, false AS refused, false AS fits FROM m
    UNION ALL SELECT source, step, used + CASE WHEN fits THEN cost ELSE 0 END, CASE WHEN part = 0 THEN NOT fits ELSE refused END, fits FROM (SELECT *, NOT optional OR ((part = 0 OR refused) AND used + cost <= {_ROOM}) AS fits FROM
      (SELECT n.*, r.used, r.refused, n.tokens + CASE WHEN r.used > 0 THEN 1 ELSE 0 END AS cost FROM r JOIN n ON n.source = r.source AND n.step = r.step + 1))),
  t AS (SELECT n.*, m.overflow, CASE WHEN m.overflow THEN NOT n.optional ELSE r.fits END AS held FROM n JOIN r USING (source, step) JOIN m USING (source)), u AS (SELECT *, bool_or(held) OVER (PARTITION BY source, id) AS some_held FROM t)
  SELECT source, overflow, kind, id, part::INTEGER AS part, tokens FROM u WHERE held UNION ALL SELECT source, overflow, kind, id, NULL, 0 FROM u WHERE NOT some_held AND part = 0 AND NOT overflow""")
def packed_sections(spark, d):
    """Every source's 40 longest lines in sections of a budget: its two longest are required (of src3 twelve, which don't
    fit), others taken whole or as a third and a fifth."""
    by = Window.partitionBy("source").orderBy(F.desc("size"), "doc_id", "ord")
    rows = chunks(spark, d).filter("source IS NOT NULL AND length(chunk) > 0").select("source", "doc_id", "ord", F.length("chunk").alias("size"))
    rows = rows.withColumn("position", F.row_number().over(by)).filter("position <= 40").withColumn("tokens", F.expr("CAST(size DIV 4 + 1 AS BIGINT)"))
    needed = F.col("position") <= F.when(F.col("source") == "src3", 12).otherwise(2)
    blocks = F.expr("array(tokens DIV 3 + 1, tokens DIV 5 + 1)")
    found = rows.select("source", (F.col("doc_id") % 3).cast("int").alias("kind"), needed.alias("required"), "position", F.concat_ws(".", "doc_id", "ord").alias("id"), "tokens", blocks.alias("fallback"))
    return R.pack_sections(found, "source", _ROOM)


_LINE_POINTS = " + ".join(f"CASE WHEN regexp_matches(lower(chunk), '{_topic_pattern(t)}') THEN {_points(t)} ELSE 0 END" for t in _TOPIC)


@query(f"""WITH l AS (SELECT lang, source AS topic, doc_id AS file, ord AS heading, {_LINE_POINTS} AS points FROM {CHUNKS} WHERE lang IS NOT NULL AND source IS NOT NULL),
  s AS (SELECT *, row_number() OVER (PARTITION BY lang, topic ORDER BY points DESC, file, heading) AS position FROM l WHERE points > 0 QUALIFY position <= 8),
  f AS (SELECT lang, source AS topic, doc_id AS file, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS position FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL QUALIFY position <= 6),
  t AS (SELECT lang, topic, max(points) + least(4, count(*)) AS score FROM s GROUP BY ALL), c AS (SELECT lang, topic, row_number() OVER (PARTITION BY lang ORDER BY score DESC, topic) AS turn FROM t QUALIFY turn <= 2),
  a AS (SELECT lang, topic, turn, 0 AS leg, position, file, heading FROM s JOIN c USING (lang, topic)), b AS (SELECT lang, topic, turn, 0 AS leg, position, file FROM a UNION ALL SELECT lang, topic, turn, 1, position, file FROM f JOIN c USING (lang, topic)),
  x AS (SELECT lang, file, heading, min((turn, leg, position, topic)) AS seen FROM a GROUP BY ALL), y AS (SELECT lang, file, NULL::INTEGER AS heading, min((turn, leg, position, topic)) AS seen FROM b GROUP BY ALL),
  z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY seen, file, heading) AS nth, 12 AS most, 'section' AS what FROM x UNION ALL SELECT *, row_number() OVER (PARTITION BY lang ORDER BY seen, file), 10, 'file' FROM y)
  SELECT lang, what, nth::INTEGER AS nth, file, heading::INTEGER AS heading, seen[4] AS topic, seen[2]::INTEGER AS leg FROM z WHERE nth <= most""")
def topic_plans(spark, d):
    """Sections and files to read for every language's two best topics (here: sources, by their lines' topic terms)."""
    low = F.lower("chunk")
    points = sum((F.when(low.rlike(_topic_pattern(t)), _points(t)).otherwise(0) for t in _TOPIC), F.lit(0))
    docs = table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", "lang", "source", "n_chars")
    lines = chunks(spark, d).filter("lang IS NOT NULL AND source IS NOT NULL").select("lang", F.col("source").alias("topic"), F.col("doc_id").alias("file"), F.col("ord").cast("int").alias("heading"), points.alias("points")).filter("points > 0")
    of = Window.partitionBy("lang", "topic")
    sections = lines.withColumn("position", F.row_number().over(of.orderBy(F.desc("points"), "file", "heading"))).filter("position <= 8")
    files = docs.select("lang", F.col("source").alias("topic"), F.col("doc_id").alias("file"), "n_chars").withColumn("position", F.row_number().over(of.orderBy(F.desc("n_chars"), "file"))).filter("position <= 6")
    topics = sections.groupBy("lang", "topic").agg((F.max("points") + F.least(F.lit(4), F.count(F.lit(1)))).alias("score"))
    a, b = R.topic_plan(topics, sections, files, "lang")
    columns = ["lang", "what", "nth", "file", "heading", "topic", "leg"]
    return a.withColumn("what", F.lit("section")).select(columns).union(b.withColumns({"what": F.lit("file"), "heading": F.lit(None).cast("int")}).select(columns))


@query(f"""WITH {CHANNELS}, u AS (SELECT id, round(sum(1 / (rank + 10.0)), 9) AS fused, min(channel * 1000000 + rank) AS met FROM c GROUP BY id), n AS (SELECT id FROM u ORDER BY fused DESC, met LIMIT 12), p AS (SELECT doc_id AS id FROM b WHERE doc_id % 2 = 0 ORDER BY score DESC, doc_id LIMIT 12),
  q AS (SELECT id FROM n UNION SELECT id FROM p) SELECT id, score FROM (SELECT doc_id AS id, round(score, 6) AS score FROM b SEMI JOIN q ON id = doc_id ORDER BY b.score DESC, id LIMIT 8)""")
def nested_prefetch(spark, d):
    """Candidates of nested searches (three channels fused, and even documents by terms), scored anew by the outer search."""
    found = scored(spark, d, TERMS)
    fused = fusion.rrf(channels(spark, d)).orderBy(F.desc("fused"), "met_channel", "met_rank").limit(12).select("id")
    even = found.filter("doc_id % 2 = 0").orderBy(F.desc("score"), "doc_id").limit(12).select(F.col("doc_id").alias("id"))
    pool = F.broadcast(fused.union(even).distinct())  # at most 24 ids
    best = found.withColumnRenamed("doc_id", "id").join(pool, "id", "left_semi").orderBy(F.desc("score"), "id").limit(8)
    return best.select("id", F.round("score", 6).alias("score"))


_QUESTION = "The price of our plan, und der Preis de la lista que"
_LIMITS = S.Limits(max_chars=3000, text_chars=2400, items=8, sources=6, reserve=100)


@query(rf"""WITH RECURSIVE {bm25_sql()}, y AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, doc_id) - 1 AS rank FROM b JOIN documents USING (doc_id) QUALIFY rank < 200),
  l AS (SELECT lang, doc_id, ord, chunk, doc_id * 16777216 + ord AS position, CASE WHEN ord = 0 AND rank < 10 THEN rank END AS rank, rank AS source_rank, regexp_replace(trim(regexp_replace(chunk, '\s+', ' ', 'g')), '^$', '') AS content FROM {CHUNKS} LEFT JOIN y USING (lang, doc_id) WHERE lang IS NOT NULL),
  m AS (SELECT lang, content, min(position) AS position, min(rank) AS rank, min(source_rank) AS source_rank, count(*) - 1 AS copies FROM l WHERE content <> '' GROUP BY ALL),
  u AS (SELECT m.*, doc_id, ord, length(chunk) AS size, length(doc_id::VARCHAR) AS named, list_distinct({TOK.format("chr(10) || chunk")}) AS terms FROM m JOIN (SELECT lang, position, doc_id, ord, chunk FROM l) USING (lang, position)),
  a AS (SELECT list_distinct({TOK.format(f"'{_QUESTION}'")}) AS asked), n AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
  h AS (SELECT lang, term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM (SELECT lang, unnest(list_intersect(terms, asked)) AS term FROM u, a) JOIN n USING (lang) GROUP BY lang, term, n), k AS (SELECT lang, list({{'t': term, 'w': w}} ORDER BY term) AS ws, sum(w) AS whole FROM h GROUP BY lang),
  c AS (SELECT u.*, ws, whole, list_sum(list_transform(list_filter(ws, lambda x: list_contains(terms, x.t)), lambda x: x.w)) / whole AS cover, size + greatest(named + 80, 100) AS cost FROM u JOIN k USING (lang)),
  v AS (SELECT *, 0.35::DOUBLE * CASE WHEN rank IS NOT NULL THEN 10::DOUBLE / (10 + rank) ELSE coalesce(10::DOUBLE / (10 + source_rank) * coalesce(cover, 0), 0) END + 0.65::DOUBLE * coalesce(cover, 0) AS rel, sqrt(1 + greatest(cost / 3000::DOUBLE, size / 2400::DOUBLE)) AS load FROM c),
  z AS MATERIALIZED (SELECT * FROM v WHERE rel <> 0 AND cost <= 3000 AND size <= 2400),
  g AS (SELECT lang, 0 AS nth, 0::BIGINT AS position, []::BIGINT[] AS taken, []::VARCHAR[][] AS sets, []::BIGINT[] AS docs, []::VARCHAR[] AS covered, 0::BIGINT AS used, 0::BIGINT AS texts, 0::DOUBLE AS score FROM (SELECT DISTINCT lang FROM z)
    UNION ALL SELECT lang, nth + 1, x.position, list_append(taken, x.position), list_append(sets, x.terms), list_distinct(list_append(docs, x.doc_id)), list_concat(covered, x.terms), used + x.cost, texts + x.size, x.score FROM
      (SELECT lang, nth, taken, sets, docs, covered, used, texts, arg_max({{'position': position, 'terms': terms, 'doc_id': doc_id, 'cost': cost, 'size': size, 'score': s}}, {{'s': s, 'p': -position}}) AS x FROM
        (SELECT g.nth, g.taken, g.sets, g.docs, g.covered, g.used, g.texts, z.*, (0.7::DOUBLE * rel + 0.3::DOUBLE * coalesce(list_sum(list_transform(list_filter(ws, lambda x: list_contains(terms, x.t) AND NOT list_contains(covered, x.t)), lambda x: x.w)), 0) / whole
            - 0.3::DOUBLE * coalesce(list_max(list_transform(sets, lambda o: len(list_intersect(o, terms)) / greatest(1, len(o) + len(terms) - len(list_intersect(o, terms)))::DOUBLE)), 0)) / load AS s
          FROM (SELECT lang, nth, taken, sets, docs, covered, used, texts FROM g WHERE nth < 8) g JOIN z USING (lang) WHERE NOT list_contains(taken, z.position) AND used + cost <= 3000 AND texts + size <= 2400 AND (len(docs) < 6 OR list_contains(docs, doc_id))) GROUP BY lang, nth, taken, sets, docs, covered, used, texts))
  SELECT lang, nth, doc_id, ord, copies, round(score, 6) AS score FROM g JOIN z USING (lang, position) WHERE nth > 0""")
def selected_context(spark, d):
    """For every language the lines of its documents that cover a question and repeat each other least: eight of six documents at
    most, within two budgets. The two hundred documents that the terms find best lend their lines a prior."""
    by = Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id")
    found = scored(spark, d, TERMS).withColumn("rank", F.row_number().over(by) - 1).filter("rank < 200").select("doc_id", "rank")
    found = F.broadcast(cut_lineage(found))  # two hundred documents a language
    lines = chunks(spark, d).filter("lang IS NOT NULL").join(found, "doc_id", "left")
    units = lines.select(
        F.col("lang").alias("question_id"), (F.col("doc_id") * (1 << 24) + F.col("ord")).alias("position"), F.col("doc_id").cast("string").alias("source"), F.col("ord").cast("string").alias("unit_id"),
        F.lit(None).cast("string").alias("grp"), F.lit(None).cast("string").alias("heading"), F.col("chunk").alias("text"), F.when((F.col("ord") == 0) & (F.col("rank") < 10), F.col("rank")).alias("rank"), F.col("rank").alias("source_rank"),
    )
    questions = table(spark, d, "documents").select(F.col("lang").alias("question_id")).filter("question_id IS NOT NULL").distinct().withColumn("question", F.lit(_QUESTION))
    picked = S.select_context(units, questions, _LIMITS)
    return picked.select(F.col("question_id").alias("lang"), "nth", F.col("source").cast("long").alias("doc_id"), F.col("unit_id").cast("int").alias("ord"), "copies", "score")

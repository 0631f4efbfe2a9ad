"""Queries over references between texts, files and messages, and over answers that must fit, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import references as N, tables as T
from tessella.plans.base import query, table
from tessella.plans.corpus import CHUNKS, chunks

_NUMBERS = f"list_filter(regexp_extract_all(coalesce(text, ''), '{N.CODE}'), lambda w: regexp_matches(w, '[0-9]') AND length(w) >= {N.NUMBER})"


@query(f"""WITH d AS (SELECT doc_id, {_NUMBERS} AS w FROM documents), o AS (SELECT w[1] AS number, min(doc_id) AS dst FROM d WHERE len(w) > 0 GROUP BY 1)
  SELECT src, dst, count(*) AS weight FROM (SELECT DISTINCT doc_id AS src, unnest(w) AS number FROM d) JOIN o USING (number) WHERE src <> dst GROUP BY ALL""")
def reference_edges(spark, d):
    """Documents whose texts mention another one's number (its first code with a digit)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return N.reference_edges(docs.select("doc_id", F.get(N.numbers(F.col("text")), F.lit(0)).alias("number")), docs)


_PATH = r"regexp_extract(url, '://([^?#]*)', 1)"


@query(rf"""WITH f AS (SELECT page_id AS file_id, list_filter(string_split(lower({_PATH}), '/'), lambda p: p <> '') AS parts, string_split(lower({_PATH}), '/')[-1] AS base FROM pages),
  n AS (SELECT file_id, array_to_string(parts[i:], '/') AS name, 10000 + length(array_to_string(parts[i:], '/')) AS score FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM f)
    UNION ALL SELECT file_id, base, 5000 + length(base) FROM f UNION ALL SELECT file_id, regexp_replace(base, '(.)\.[^.]*$', '\1'), 1000 + length(regexp_replace(base, '(.)\.[^.]*$', '\1')) FROM f WHERE length(regexp_replace(base, '(.)\.[^.]*$', '\1')) >= 8),
  q AS (SELECT page_id AS question_id, lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) AS q FROM pages), h AS MATERIALIZED (SELECT question_id, file_id, q, name, score FROM q JOIN (SELECT DISTINCT * FROM n WHERE name <> '') n ON contains(q, name)), m AS (SELECT question_id, file_id, max(score)::INTEGER AS score FROM h WHERE regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_-])' || regexp_escape(name) || '($|[^\p{{L}}\p{{N}}_-])') GROUP BY ALL)
  SELECT question_id, CASE WHEN count(*) = 1 THEN 'matched' ELSE 'ambiguous' END AS status, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(file_id) END AS file_id, score FROM m SEMI JOIN (SELECT question_id, max(score) AS score FROM m GROUP BY 1) b USING (question_id, score) GROUP BY question_id, score""")
def file_references(spark, d):
    """Which pages a path without its host names: by the ends of their own paths, the longest one wins."""
    pages = table(spark, d, "pages")
    questions = pages.select(F.col("page_id").alias("question_id"), F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("question"))
    return N.resolved(questions, pages.select(F.col("page_id").alias("file_id"), F.regexp_extract("url", "://([^?#]*)", 1).alias("path")))


#: Turns as messages: one answers the turn before and refers to all earlier ones; the system's own turns aren't stored.
_MESSAGES = "SELECT conv_id, turn, conv_id || '.' || turn AS id, text, CASE WHEN turn > 0 THEN conv_id || '.' || (turn - 1) END AS up FROM conversations WHERE role <> 'system'"


def _messages(spark, d):
    up = F.when(F.col("turn") > 0, F.concat_ws(".", "conv_id", F.col("turn") - 1))
    refs = F.when(F.col("turn") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest("turn", F.lit(1)) - 1), lambda t: F.concat_ws(".", F.col("conv_id"), t)))
    return table(spark, d, "conversations").filter("role <> 'system'").select("conv_id", "turn", F.concat_ws(".", "conv_id", "turn").alias("id"), "text", up.alias("in_reply_to"), refs.alias("refs"))


@query(f"""WITH m AS ({_MESSAGES}) SELECT a.id AS message, arg_max(b.id, b.turn) AS reply_to FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.turn < a.turn GROUP BY a.id""")
def reply_edges(spark, d):
    """Each message's answered one, or the last earlier one that is known where that is missing."""
    return N.reply_edges(_messages(spark, d))


@query(rf"""WITH RECURSIVE m AS ({_MESSAGES}), c AS (SELECT id, up AS above FROM m UNION ALL SELECT c.id, m.up FROM c JOIN m ON m.id = c.above), r AS (SELECT id, arg_min(above, split_part(above, '.', 2)::INT) AS root FROM c WHERE above IS NOT NULL GROUP BY id),
  s AS (SELECT *, lower(trim(regexp_replace(regexp_replace(text, '(?i)^\s*((re|fw|fwd|ответ|пересл)\s*:\s*)+', ''), '\s+', ' ', 'g'))) AS subject FROM m LEFT JOIN r USING (id))
  SELECT conv_id, turn, substr(sha256(coalesce(root, nullif(subject, ''), id)), 1, 12) AS thread FROM s""")
def thread_keys(spark, d):
    """A message's thread: the end of its chain of answers, stored or not; else its subject without reply marks; else its own id."""
    rows = _messages(spark, d)
    ends = N.roots(rows.select("id", F.col("in_reply_to").alias("up"))).filter("root <> id")
    key = F.coalesce("root", F.nullif(X.subject_key(F.col("text")), F.lit("")), "id")
    return rows.join(ends, "id", "left").select("conv_id", "turn", F.substring(F.sha2(key, 256), 1, 12).alias("thread"))


@query(f"""WITH p AS (SELECT source, doc_id, 0 AS kind, row_number() OVER (PARTITION BY source ORDER BY length(chunk) DESC, doc_id, ord) AS rank, doc_id::VARCHAR AS unit, to_json({{'id': doc_id || '.' || ord, 'text': chunk}})::VARCHAR AS body FROM {CHUNKS} WHERE source IS NOT NULL AND length(chunk) > 0),
  a AS (SELECT source, doc_id, 1 AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, NULL AS unit, to_json({{'alias': lang, 'of': doc_id}})::VARCHAR AS body FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
  x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind, rank) AS place FROM (FROM p UNION ALL FROM a) QUALIFY place <= 60),
  u AS (SELECT *, 1 + sum(length(body) + 1) OVER w AS used, sum(CASE WHEN unit IS NOT NULL AND n = 1 THEN 1 ELSE 0 END) OVER w AS units FROM (SELECT *, row_number() OVER (PARTITION BY source, unit ORDER BY kind, rank) AS n FROM x) WINDOW w AS (PARTITION BY source ORDER BY kind, rank))
  SELECT source, kind, rank, place::INTEGER AS place, used::BIGINT AS used, units::BIGINT AS units FROM u WHERE used <= 9000 AND units <= 12""")
def fitted_answers(spark, d):
    """What of every source's lines, longest first, and of its documents' languages fits an answer's three limits."""
    lines = chunks(spark, d).filter("source IS NOT NULL AND length(chunk) > 0").select("source", "doc_id", "ord", "chunk")
    nth = lambda *order: F.row_number().over(Window.partitionBy("source").orderBy(*order))
    # the first sixty of each kind are all that can fit
    p = lines.withColumn("rank", nth(F.desc(F.length("chunk")), "doc_id", "ord")).filter("rank <= 60")
    p = p.select("source", F.lit(0).alias("kind"), "rank", F.col("doc_id").cast("string").alias("unit"), F.to_json(F.struct(F.concat_ws(".", "doc_id", "ord").alias("id"), F.col("chunk").alias("text"))).alias("body"))
    a = table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").withColumn("rank", nth("doc_id")).filter("rank <= 60")
    a = a.select("source", F.lit(1).alias("kind"), "rank", F.lit(None).cast("string").alias("unit"), F.to_json(F.struct(F.col("lang").alias("alias"), F.col("doc_id").alias("of"))).alias("body"))
    return N.fitted(p.union(a), "source", 9000, 60, 12).select("source", "kind", F.col("rank").cast("long").alias("rank"), "place", "used", "units")


#: Parts under full names, and under their last word alone, as two kinds of source; a brand is the unit.
_PARTS = """SELECT p_brand AS unit, p_name AS name, 'spec' AS kind, p_size::DOUBLE AS qty FROM part UNION ALL SELECT p_brand, split_part(p_name, ' ', 2), 'invoice', p_size + CASE WHEN p_size > 40 THEN 0.5 ELSE 0 END FROM part WHERE p_size > 10
  UNION ALL SELECT p_brand, p_name || ' ' || p_type, 'invoice', 1 FROM part WHERE p_size = 7"""


@query(f"""WITH RECURSIVE p AS ({_PARTS}), n AS (SELECT unit, name, row_number() OVER (PARTITION BY unit ORDER BY name) AS i FROM (SELECT DISTINCT unit, name FROM p)), l AS (SELECT unit, list(name ORDER BY i) AS names FROM n GROUP BY unit),
  r AS (SELECT unit, 0::BIGINT AS i, []::BIGINT[] AS c FROM l UNION ALL SELECT r.unit, r.i + 1, list_append(c, coalesce(list_min(list_transform(list_filter(range(1, r.i + 1), lambda j: least(length(names[j]), length(names[r.i + 1])) >= 4 AND (contains(names[j], names[r.i + 1]) OR contains(names[r.i + 1], names[j]))), lambda j: c[j])), r.i + 1)) FROM r JOIN l USING (unit) WHERE r.i < len(names)),
  f AS (SELECT unit, unnest(names) AS name, names[unnest(c)] AS cluster FROM (SELECT unit, c FROM r JOIN l USING (unit) WHERE i = len(names)) JOIN l USING (unit)),
  w AS (SELECT unit, cluster, arg_min(name, {{'n': -length(name), 's': name}}) AS name, count(DISTINCT name) AS names, round(sum(qty) FILTER (kind = 'spec'), 6) AS spec, round(sum(qty) FILTER (kind = 'invoice'), 6) AS invoice FROM p JOIN f USING (unit, name) GROUP BY unit, cluster)
  SELECT *, CASE WHEN spec IS NOT NULL AND invoice IS NOT NULL AND greatest(spec, invoice) - least(spec, invoice) > greatest(1e-6, greatest(spec, invoice) * 0.01) THEN 'mismatch' WHEN spec IS NULL OR invoice IS NULL THEN 'gap' ELSE 'match' END AS status FROM w""")
def reconciled_clusters(spark, d):
    """Parts by clusters of names that hold each other, within a brand: quantities of two kinds of source and their status."""
    part = table(spark, d, "part")
    brand, size = F.col("p_brand").alias("unit"), F.col("p_size").cast("double")
    spec = part.select(brand, F.col("p_name").alias("name"), F.lit("spec").alias("kind"), size.alias("qty"))
    short = part.filter("p_size > 10").select(brand, F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("invoice"), size + F.when(F.col("p_size") > 40, 0.5).otherwise(0.0))
    typed = part.filter("p_size = 7").select(brand, F.concat_ws(" ", "p_name", "p_type"), F.lit("invoice"), F.lit(1.0))
    return T.reconciled(spec.union(short).union(typed), "unit", "name", "kind", ["spec", "invoice"], "qty")

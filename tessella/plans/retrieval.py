"""Queries over terms, vectors, fused lists and document structure, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import chunking, lexical, structure, vectors
from tessella.plans.base import query, table
from tessella.plans.corpus import CHANNELS, CHUNKS, TERMS, TOK, channels, chunks

WORDS = f"(SELECT doc_id, {TOK.format('text')} AS w FROM documents)"


@query(f"SELECT doc_id, array_to_string(list_filter(w, lambda t: length(t) < 3 OR contains(t, '_') OR contains(t, '/')), ' ') AS tokens FROM {WORDS}")
def compact_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.compact_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, md5(array_to_string(flatten(list_transform(w, lambda t: CASE WHEN regexp_full_match(t, '[a-zа-яёı]+(-[a-zа-яёı]+)+') THEN list_concat([t], string_split(t, '-')) ELSE [t] END)), ' ')) AS terms FROM {WORDS}")
def reading_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(X.reading_terms(F.col("text")), " ")).alias("terms"))


@query(f"""WITH d AS {WORDS}, m AS (SELECT avg(len(w)) AS mean FROM d), t AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d)
  SELECT doc_id, term, round(2.2 * count(*) / (count(*) + 1.2 * (0.25 + 0.75 * length / any_value(mean))), 6) AS weight FROM t, m GROUP BY doc_id, term, length""")
def weighted_terms(spark, d):
    return lexical.weighted_terms(table(spark, d, "documents")).withColumn("weight", F.round("weight", 6))


@query(f"""WITH q AS (SELECT term, count(*) AS n FROM (SELECT unnest({TOK.format('text')}) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) GROUP BY term), t AS (SELECT doc_id, unnest(w) AS term FROM {WORDS})
  SELECT doc_id, sum(n)::BIGINT AS score FROM t JOIN q USING (term) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def sparse_dot(spark, d):
    """Inner products of hashed term vectors with that of the first benchmark passage."""
    b = table(spark, d, "benchmark")
    first = b.orderBy("item_id").limit(1).select(F.col("item_id").alias("doc_id"), "text")
    return lexical.sparse_dot(lexical.sparse_vectors(table(spark, d, "documents")), lexical.sparse_vectors(first)).orderBy(F.col("score").desc(), "doc_id").limit(20)


@query(f"""WITH c AS {CHUNKS}, t(term) AS (VALUES ('the'), ('of'), ('our')), h AS (SELECT doc_id, ord, term, list_contains({TOK.format('chunk')}, term) AS hit, count(*) OVER (PARTITION BY doc_id, term) AS n FROM c, t),
  f AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY doc_id, term) AS f FROM h), s AS (SELECT doc_id, ord, round(sum(ln(1 + (n - f + 0.5) / (f + 0.5))), 6) AS score FROM f WHERE hit GROUP BY doc_id, ord)
  SELECT doc_id, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS nth FROM s) WHERE nth <= 3""")
def rank_in_document(spark, d):
    """The three best lines of every document, weighted by how rare a term is among its own lines."""
    return structure.best_lines(table(spark, d, "documents"), TERMS, 3)


ROW = "{0}.embedding[{1} * 8 + 1:{1} * 8 + 8]::DOUBLE[]"


@query(f"""SELECT e.vec_id, round(list_sum(list_transform(range(8), lambda i: list_max(list_transform(range(8), lambda j: list_inner_product({ROW.format("q", "i")}, {ROW.format("e", "j")}))))), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 20""")
def maxsim(spark, d):
    """Late interaction: vectors as eight rows of eight; per row of the query the best row, summed."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(vectors.maxsim(F.col("embedding"), vectors.query_vector(e, 0), 8), 6).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(20)


@query("SELECT vec_id, label FROM embeddings WHERE vec_id > 100 AND label NOT IN (3, 5) AND (label = 1 OR vec_id % 2 = 0) ORDER BY vec_id LIMIT 50")
def scroll_page(spark, d):
    """A page after a cursor, of rows that pass a payload filter (must, must not, should)."""
    wanted = vectors.payload_filter(must_not=[F.col("label").isin(3, 5)], should=[F.col("label") == 1, F.col("vec_id") % 2 == 0])
    return vectors.scroll(table(spark, d, "embeddings"), 100, 50, wanted).select("vec_id", "label")


@query("""WITH h AS (SELECT sha1(text) AS h, min(vec_id) AS reused_from FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY 1) SELECT doc_id, reused_from FROM documents LEFT JOIN h ON sha1(text) = h.h""")
def embedding_reuse(spark, d):
    """Whose vector a text can take over: that of the smallest id with the same content; null where it must be embedded."""
    docs = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("key"))
    cached = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return vectors.reuse(docs, cached).select("doc_id", "reused_from")


@query(f"WITH {CHANNELS} SELECT id, round(score, 6) AS score FROM c WHERE channel = 1 AND id NOT IN (SELECT id FROM c WHERE channel = 0)")
def hierarchy_candidates(spark, d):
    """Routed candidates that the global list lacks."""
    c = channels(spark, d)
    return c.filter("channel = 1").join(c.filter("channel = 0").select("id"), "id", "left_anti").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH c AS {CHUNKS}, h AS (SELECT doc_id, chunk, min(ord) AS met FROM c WHERE length(chunk) BETWEEN 1 AND 60 GROUP BY doc_id, chunk), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY met) AS nth FROM h), k AS (SELECT doc_id, string_agg(chunk, ' | ' ORDER BY met) AS headings FROM r WHERE nth <= 3 GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS units FROM c GROUP BY doc_id) SELECT doc_id, units, coalesce(headings, '') AS headings FROM n LEFT JOIN k USING (doc_id)""")
def context_catalog(spark, d):
    """Units of every document and its first three distinct short lines."""
    lines = F.split("text", "\n")
    heads = F.slice(F.array_distinct(F.filter(lines, lambda x: F.length(x).between(1, 60))), 1, 3)
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("units"), F.array_join(heads, " | ").alias("headings"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER w AS nth, sum(n_chars) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, used::BIGINT AS used FROM r WHERE nth <= 32 AND used <= 20000""")
def prefix_page(spark, d):
    """Per source the first documents, at most 32, as long as all of them fit a budget."""
    w = Window.partitionBy("source").orderBy("doc_id")
    head = table(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("nth", F.row_number().over(w)).filter("nth <= 32")
    return head.withColumn("used", F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("used <= 20000").select("source", "doc_id", "used")


@query(f"""SELECT doc_id, (ord // 4)::BIGINT AS section, count(*) AS fragments, count(*) FILTER (contains(chunk, 'our')) AS admitted, CASE WHEN count(*) FILTER (contains(chunk, 'our')) = count(*) THEN 'complete' WHEN count(*) FILTER (contains(chunk, 'our')) > 0 THEN 'partial' ELSE 'unknown' END AS coverage FROM {CHUNKS} GROUP BY ALL""")
def coverage_report(spark, d):
    """Fragments of every section and how many of them a search admitted."""
    rows = chunks(spark, d).groupBy("doc_id", F.floor(F.col("ord") / 4).alias("section"))
    counted = rows.agg(F.count(F.lit(1)).alias("fragments"), F.count_if(F.contains("chunk", F.lit("our"))).alias("admitted"))
    return counted.withColumn("coverage", F.when(F.col("admitted") == F.col("fragments"), "complete").when(F.col("admitted") > 0, "partial").otherwise("unknown"))


@query("""WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), l AS (SELECT doc_id, n, lv AS level, pow(8, lv)::BIGINT AS width FROM n, (VALUES (1), (2), (3)) AS v(lv) WHERE n > pow(8, lv - 1)), e AS (SELECT *, unnest(range(ceil(n / width)::BIGINT)) AS node FROM l)
  SELECT doc_id, level, node, least(width, n - node * width)::BIGINT AS leaves, substr(sha256(doc_id || ':' || level || ':' || node), 1, 32) AS node_id FROM e""")
def raptor_levels(spark, d):
    """Summary trees: up to three levels of groups of eight over every document's lines."""
    return structure.tree_levels(table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n")), fanout=8, most=3)


@query("""WITH g AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM g)),
  t AS (SELECT string_split(text, ' ') AS w FROM documents), a AS (SELECT DISTINCT array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 3)) AS i FROM t))
  SELECT item_id, count(*) AS grams, count(a.gram) AS found, round(count(a.gram) / count(*), 6) AS coverage FROM b LEFT JOIN a USING (gram) GROUP BY item_id""")
def ngram_coverage(spark, d):
    """Share of every benchmark passage's five-word sequences that occur in some document."""
    return structure.ngram_coverage(table(spark, d, "benchmark"), table(spark, d, "documents"), 5)


@query(r"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, coalesce(b.text, '') AS src FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
  w AS (SELECT *, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]{3,}', 0)) AS aw, list_distinct(regexp_extract_all(lower(src), '[a-z0-9]{3,}', 0)) AS sw, regexp_extract_all(answer, '[0-9]+', 0) AS an, regexp_extract_all(src, '[0-9]+', 0) AS sn FROM p)
  SELECT conv_id, turn, CASE WHEN src = '' OR answer = '' THEN 'NO_DATA' WHEN contains(src, answer) THEN 'VERIFIED' WHEN len(list_filter(an, lambda x: NOT list_contains(sn, x))) > 0 THEN 'HALLUCINATION' WHEN len(aw) > 0 AND len(list_intersect(aw, sw)) / len(aw) >= 0.35 THEN 'VERIFIED' ELSE 'HALLUCINATION' END AS status FROM w""")
def rules_validate(spark, d):
    """Answers against the turn before them: verbatim, foreign numbers, share of common words."""
    c = table(spark, d, "conversations")
    src = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"))
    pairs = c.filter("role = 'assistant'").join(src, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").alias("answer"), F.coalesce("src", F.lit("")).alias("src"))
    return pairs.select("conv_id", "turn", X.verdict(F.col("answer"), F.col("src")).alias("status"))


ROUTES = (("compare", r"\b(compare|versus|difference)\b"), ("count", r"\b(how many|count|total)\b"), ("explain", r"\b(why|explain|how)\b"), ("find", r"\b(what|which|where|find)\b"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in ROUTES) + " ELSE 'chat' END AS route FROM conversations WHERE role = 'user'")
def route_query(spark, d):
    """The first route in order whose words a question holds."""
    route = reduce(lambda c, r: c.when(F.lower("text").rlike(r[1]), r[0]), ROUTES[1:], F.when(F.lower("text").rlike(ROUTES[0][1]), ROUTES[0][0])).otherwise("chat")
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", route.alias("route"))


@query(r"""WITH q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS word FROM conversations WHERE role = 'user'), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS known FROM benchmark),
  p AS (SELECT word, known, levenshtein(word, known) AS distance FROM q, k WHERE length(word) >= 4 AND length(known) >= 4 AND abs(length(word) - length(known)) <= 2 AND word NOT IN (SELECT known FROM k))
  SELECT word, known, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, known) AS nth FROM p WHERE distance <= CASE WHEN length(word) <= 6 THEN 1 ELSE 2 END) WHERE nth = 1""")
def correct_words(spark, d):
    """The nearest dictionary word of words that the dictionary lacks, within one or (from seven letters) two edits."""
    words = lambda rows, name: rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias(name)).distinct().filter(F.length(name) >= 4)
    return lexical.corrections(words(table(spark, d, "conversations").filter("role = 'user'"), "word"), words(table(spark, d, "benchmark"), "known")).withColumn("distance", F.col("distance").cast("long"))


@query("""SELECT doc_id, array_to_string(lines[a:CASE WHEN b IS NULL THEN len(lines) ELSE a + b - 1 END], chr(10)) AS clause FROM (SELECT *, list_position(list_transform(lines[a + 1:], lambda x: contains(x, '#')), true) AS b FROM
  (SELECT doc_id, lines, list_position(list_transform(lines, lambda x: contains(x, '#')), true) AS a FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE a > 0)""")
def clause_lookup(spark, d):
    """The first marked line of every document with what follows it up to the next."""
    return structure.first_clause(table(spark, d, "documents"), lambda line: F.contains(line, F.lit("#")))


@query("""SELECT page_id, array_to_string(list_slice(parts, greatest(1, len(parts) - 4), len(parts)), ' / ') AS title, NOT regexp_matches(parts[-1], '^(~\\$|\\.~lock\\.|\\._)') AS visible FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages)""".replace("\\\\", "\\"))
def catalog_title(spark, d):
    """The last five parts of a path, and whether its file is a document that users see."""
    parts = F.filter(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), lambda x: x != "")
    return table(spark, d, "pages").select("page_id", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 4, F.lit(1)), F.lit(5)), " / ").alias("title"), X.visible_document(F.element_at(parts, -1)).alias("visible"))


@query()
def chunk_pages(spark, d):
    """Windows of 1,200 characters that overlap by 150."""
    return chunking.chunk_pages(table(spark, d, "documents"), 1200, 150)


@query()
def embedding_chunks(spark, d):
    """Chunks that fit a budget of 400 blank-separated words and join again to the cleaned text."""
    return chunking.embedding_chunks(table(spark, d, "documents"), 400)


@query()
def markdown_sections(spark, d):
    return chunking.markdown_sections(table(spark, d, "documents"))

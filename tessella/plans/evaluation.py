"""Queries over evaluation, selection, document-level fusion, text rules and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import unicode as U
from tessella.operators import fusion, postings, vectors, snowball as SB
from tessella.plans.base import query, shared, table
from tessella.plans.corpus import CHANNELS, CHUNKS, TERMS, TOK, TOP, bm25_sql, channels, chunks, fused_sql, store

#: Letters under which the tables' Latin words are read as Cyrillic ones, as the tables hold none.
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмноящрстувюьыз"
_STEM = " ".join(f"WHEN ends_with(w, '{e}') AND length(w) >= {len(e) + 4} THEN left(w, length(w) - {len(e)})" for e in X.LIGHT_ENDINGS)


@query(f"""WITH t AS (SELECT translate(unnest({TOK.format('text')}), '{LATIN}', '{CYRILLIC}') AS w FROM documents)
  SELECT stem, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(w, '[а-яё]{{4,}}') THEN CASE {_STEM} ELSE w END ELSE w END AS stem FROM t) GROUP BY stem""")
def light_stems(spark, d):
    """Words by stem; every distinct word is stemmed once."""
    words = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return words.select(X.light_stem(F.translate("w", LATIN, CYRILLIC)).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


_NUMBER = "CASE event_id % 5 WHEN 0 THEN ' -' || event_id WHEN 1 THEN event_id || '_' || user_id WHEN 2 THEN '-' || repeat(event_id::VARCHAR, 6) WHEN 3 THEN '+' || repeat(event_id::VARCHAR, 6) ELSE event_id || '__1' END"


@query(rf"""WITH e AS (SELECT event_id, trim({_NUMBER}) AS s FROM events), f AS (SELECT *, regexp_replace(regexp_replace(s, '[^0-9]', '', 'g'), '^0+', '') AS g FROM e)
  SELECT event_id, CASE WHEN NOT regexp_full_match(s, '[+-]?[0-9]+(_[0-9]+)*') THEN NULL WHEN length(g) > 19 OR try_cast(g AS HUGEINT) > 9223372036854775807 THEN CASE WHEN s LIKE '-%' THEN -9223372036854775808 ELSE 9223372036854775807 END
    ELSE (CASE WHEN s LIKE '-%' THEN -1 ELSE 1 END) * try_cast(coalesce(nullif(g, ''), '0') AS HUGEINT) END::BIGINT AS value FROM f""")
def saturated_integers(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id").cast("string")
    form = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" -"), i)).when(F.col("event_id") % 5 == 1, F.concat(i, F.lit("_"), F.col("user_id").cast("string")))
    form = form.when(F.col("event_id") % 5 == 2, F.concat(F.lit("-"), F.repeat(i, 6))).when(F.col("event_id") % 5 == 3, F.concat(F.lit("+"), F.repeat(i, 6))).otherwise(F.concat(i, F.lit("__1")))
    return e.select("event_id", X.saturated_integer(form).alias("value"))


@query("""SELECT doc_id, md5(text) AS composed, md5(replace(lower(text), 'ß', 'ss')) AS folded FROM documents""")
def unicode_forms(spark, d):
    """Digests of texts' compatibility composition (which these tables' texts are already) and full case folding."""
    return table(spark, d, "documents").select("doc_id", F.md5(U.nfkc("text")).alias("composed"), F.md5(U.full_casefold("text")).alias("folded"))


_SPELLED = ["шт.", " Штук ", "М2", "кв. м", "тонн", "Пог. м", "box", ""]


@query(f"""WITH u(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in X.UNITS.items())}), p AS (SELECT p_partkey, p_name, replace(lower(trim(list_extract([{", ".join(f"'{s}'" for s in _SPELLED)}], (p_partkey % 8 + 1)::INTEGER))), 'ё', 'е') AS unit FROM part)
  SELECT p_partkey, coalesce(b, unit) AS unit, lower(trim(regexp_replace('  ' || upper(p_name) || '  x ', '\\s+', ' ', 'g'))) AS name FROM p LEFT JOIN u ON a = unit""".replace("\\\\", "\\"))
def unit_names(spark, d):
    unit = F.element_at(F.array(*map(F.lit, _SPELLED)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.normalized_unit(unit).alias("unit"), X.normalized_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  x "))).alias("name"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(^|\n)#{1,6} ')) AS headings FROM documents""")
def heading_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("(^|\n)#{1,6} ")).cast("long").alias("headings"))


@query(f"""SELECT source, heading, count(*) AS chunks FROM (SELECT source, coalesce(nullif(regexp_extract(chunk, '^#{{1,6}} +([^\r\n]*)', 1), ''), CASE WHEN ord = 0 THEN lang END, '') AS heading FROM {CHUNKS}) WHERE heading <> '' GROUP BY ALL ORDER BY chunks DESC, source, heading LIMIT 600""")
def section_signals(spark, d):
    """The most frequent headings of sources: a line's own, else (for a first line) its parent's."""
    own = F.nullif(F.regexp_extract("chunk", "^#{1,6} +([^\r\n]*)", 1), F.lit(""))
    rows = chunks(spark, d).select("source", F.coalesce(own, F.when(F.col("ord") == 0, F.col("lang"))).alias("heading")).filter("heading <> ''")
    return rows.groupBy("source", "heading").agg(F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("chunks"), "source", "heading").limit(600)


@query("""WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
  g AS (SELECT source, lang, min(CASE WHEN rank <= 10 THEN rank END) AS rank FROM r JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source, lang)
  SELECT source, count(*) AS gold_groups, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall10, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, bool_and(rank IS NOT NULL) AS complete_support FROM g GROUP BY source""")
def recall_mrr(spark, d):
    """Every source's longest documents as a ranking, judged by gold groups (its good documents by language): recall at 5 and
    10, reciprocal rank of the first hit, and whether all groups are met."""
    docs, good = table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1").select("doc_id")
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = docs.select("source", "doc_id", "n_chars").withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("doc_id", "rank")
    groups = docs.select("source", "lang", "doc_id").join(good, "doc_id").join(top, "doc_id", "left").groupBy("source", "lang").agg(F.min("rank").alias("rank"))
    share = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return groups.groupBy("source").agg(
        F.count(F.lit(1)).alias("gold_groups"), share(5).alias("recall5"), share(10).alias("recall10"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"), F.every(F.col("rank").isNotNull()).alias("complete_support")
    )


@query(f"""WITH c AS (SELECT DISTINCT ON (chunk) doc_id, ord, chunk, length(chunk) AS size FROM {CHUNKS} WHERE length(chunk) > 0 ORDER BY chunk, doc_id, ord),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, ord) AS nth FROM c) SELECT doc_id, ord, size FROM n WHERE nth <= 2 ORDER BY n.size DESC, doc_id, ord LIMIT 50""")
def diverse_candidates(spark, d):
    """The longest distinct lines in order, at most two of a document; equal lines are collapsed to the first before."""
    first = chunks(spark, d).filter(F.length("chunk") > 0).groupBy("chunk").agg(F.min(F.struct("doc_id", "ord")).alias("first"))
    rows = first.select("first.doc_id", "first.ord", F.length("chunk").cast("long").alias("size"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), "ord"))
    return rows.withColumn("nth", nth).filter("nth <= 2").orderBy(F.desc("size"), "doc_id", "ord").limit(50).select("doc_id", "ord", "size")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, lower(text) AS question, vec_id % 3 <> 0 AS verified FROM embeddings JOIN documents ON doc_id = vec_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS newest FROM e WHERE verified),
  s AS (SELECT q.vec_id AS query_id, n.vec_id AS hit, CASE WHEN n.question = q.question THEN 1.0 ELSE round(list_cosine_similarity(q.v, n.v), 9) END AS similarity FROM e q JOIN n ON n.label = q.label WHERE q.vec_id % 50 = 0 AND n.newest <= 500 AND n.vec_id <> q.vec_id)
  SELECT query_id, hit, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, hit DESC) AS nth FROM s) WHERE nth = 1 AND similarity >= 0.1""")
def semantic_lookup(spark, d):
    """Cached answers: among the newest 500 verified ones of a question's scope the most similar, an equal question counting as
    1 and the newest winning a tie, if it is similar enough."""
    e = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.sha2(F.lower("text"), 256).alias("question")), "vec_id")  # equal questions by digest, so that pairs carry no text
    newest = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id")))
    held = e.filter("vec_id % 3 <> 0").withColumn("newest", newest).filter("newest <= 500").select("label", F.col("vec_id").alias("hit"), F.col("embedding").alias("b"), F.col("question").alias("known"))
    asked = e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    close = F.when(F.col("known") == F.col("question"), F.lit(1.0)).otherwise(F.round(vectors.cosine(F.col("embedding"), F.col("b")), 9))
    best = asked.join(held, "label").filter("hit <> query_id").groupBy("query_id").agg(F.max(F.struct(close.alias("similarity"), "hit")).alias("best"))
    return best.filter("best.similarity >= 0.1").select("query_id", F.col("best.hit").alias("hit"), F.round("best.similarity", 6).alias("similarity"))


@query(fused_sql("1 / (rank + 61.0)", ", e AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY rank) - 1 AS rank FROM c WHERE id % 7 <> 0)").replace("FROM c GROUP BY id", "FROM e GROUP BY id") + TOP)
def hierarchy_fusion(spark, d):
    """Reciprocal ranks (k 60, from 1) of evidence alone: navigation rows, here ids divisible by 7, leave before rows are ranked."""
    evidence = channels(spark, d).filter("id % 7 <> 0")
    rank = F.row_number().over(Window.partitionBy("channel").orderBy("rank")) - 1
    return fusion.rrf(evidence.withColumn("rank", rank), 20, k=60, base=1).select("id", F.round("fused", 6).alias("fused"))


@query(f"""WITH {CHANNELS}, x AS (SELECT c.*, source FROM c JOIN documents ON doc_id = id), p AS (SELECT channel, source, min(rank) AS best FROM x GROUP BY ALL),
  q AS (SELECT channel, source, row_number() OVER (PARTITION BY channel ORDER BY best) - 1 AS rank FROM p), y AS (SELECT source, round(sum(1 / (rank + 10.0)), 9) AS score, min(channel * 1000000 + rank) AS met FROM q GROUP BY source),
  z AS (SELECT * FROM y ORDER BY score DESC, met LIMIT 6), i AS (SELECT id, source, round(sum(1 / (rank + 10.0)), 9) AS fused, min(channel * 1000000 + rank) AS met FROM x GROUP BY id, source),
  a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fused DESC, met) AS anchor FROM i) SELECT a.source, round(score, 6) AS score, id, anchor::INTEGER AS anchor FROM a JOIN z USING (source) WHERE anchor <= 2""")
def fused_documents(spark, d):
    """Fusion of whole sources by their best rows, and of the six best ones the two rows that fuse best inside."""
    rows = channels(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    best = rows.groupBy("channel", F.col("source").alias("id")).agg(F.min("rank").alias("best"), F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy("best")) - 1)
    top = fusion.rrf(ranked, 6).select(F.col("id").alias("source"), F.round("fused", 6).alias("score"))
    inner = fusion.rrf(rows.drop("source")).join(rows.select("id", "source").distinct(), "id")
    anchor = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("fused"), "met_channel", "met_rank"))
    return inner.withColumn("anchor", anchor).filter("anchor <= 2").join(F.broadcast(top), "source").select("source", "score", "id", "anchor")


@query(fused_sql("1 / (rank + 2.0)").replace("LIMIT 50", "LIMIT 30") + """, r AS (SELECT *, row_number() OVER (ORDER BY fused DESC, met) AS fusion_rank, best = 0 AS leader FROM u),
  k AS (SELECT *, count(*) FILTER (leader) OVER () AS heads, count(*) FILTER (NOT leader) OVER (ORDER BY fusion_rank) AS others FROM r) SELECT id, round(fused, 6) AS fused, fusion_rank::INTEGER AS fusion_rank FROM k WHERE leader OR others <= 15 - heads""")
def hybrid_leg(spark, d):
    """Fifteen rows of lexical and dense search, each read twice as deep (24 at least), fused with both heads kept."""
    limit = 15
    return fusion.preserve_heads(fusion.rrf(channels(spark, d, max(2 * limit, 24)), k=2), limit).select("id", F.round("fused", 6).alias("fused"), "fusion_rank")


@query("""SELECT * FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY rank IS NULL, coalesce(rank, source_rank), doc_id))::INTEGER AS position
  FROM (SELECT source, doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 7919 % 1000 END AS rank, doc_id * 104729 % 500 AS source_rank FROM documents)) WHERE position <= 20""")
def rrf_order(spark, d):
    """Units in the order of their fused rank, those without one after them by their rank in the source: the first 20 of every question."""
    rows = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") * 7919 % 1000).alias("rank"), (F.col("doc_id") * 104729 % 500).alias("source_rank"))
    order = Window.partitionBy("source").orderBy(F.col("rank").isNull(), F.coalesce("rank", "source_rank"), "doc_id")
    return rows.withColumn("position", F.row_number().over(order)).filter("position <= 20").select("source", "doc_id", "position")


_BOOST = ["with", "from", "their", "src1"]


@query(f"""WITH t(t) AS (VALUES {", ".join(f"('{t}')" for t in _BOOST)}), d AS (SELECT doc_id, source, n_chars / 100000.0 AS score, lower(source || chr(10) || text) AS hay FROM documents),
  m AS (SELECT doc_id, any_value(score) AS score, count(*) FILTER (contains(hay, t)) AS hits, count(*) FILTER (contains(lower(source), t)) AS titles FROM d, t GROUP BY doc_id)
  SELECT doc_id, round(score + 0.12 * hits + 0.03 * titles, 6) AS boosted FROM m ORDER BY round(score + 0.12 * hits + 0.03 * titles, 6) DESC, score DESC, doc_id LIMIT 30""")
def lexical_boost(spark, d):
    """A retrieval score with a little for every term of the question in name and text, and in the name again."""
    hay, title = F.lower(F.concat_ws("\n", "source", "text")), F.lower("source")
    count = lambda c: sum((F.when(F.contains(c, F.lit(t)), 1).otherwise(0) for t in _BOOST), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 100000).alias("score"), count(hay).alias("hits"), count(title).alias("titles"))
    boosted = F.round(F.col("score") + 0.12 * F.col("hits") + 0.03 * F.col("titles"), 6)
    return rows.withColumn("boosted", boosted).orderBy(F.desc("boosted"), F.desc("score"), "doc_id").limit(30).select("doc_id", "boosted")


@query(f"""WITH x AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), c AS (SELECT doc_id, ord, chunk, doc_id IN (FROM x) AS exact FROM {CHUNKS} WHERE length(chunk) > 20)
  SELECT doc_id, min(ord) AS ord, sha1(chunk) AS chunk, any_value(exact) AS exact FROM c WHERE exact OR ord > 0 GROUP BY doc_id, chunk""")
def evidence_merge(spark, d):
    """Exact evidence, and semantic evidence of documents that the exact one doesn't cover; equal passages of a document once."""
    covered = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    rows = chunks(spark, d).filter(F.length("chunk") > 20).select("doc_id", "ord", F.sha1("chunk").alias("chunk"))
    exact = rows.join(covered, "doc_id", "left_semi").withColumn("exact", F.lit(True))
    other = rows.filter("ord > 0").join(covered, "doc_id", "left_anti").withColumn("exact", F.lit(False))
    return exact.union(other).groupBy("doc_id", "chunk").agg(F.min("ord").alias("ord"), F.first("exact").alias("exact"))


@query("""SELECT source, count(*) AS documents, count(vec_id) AS dense, count(*) FILTER (length(text) > 0) AS lexical, count(vec_id) FILTER (length(text) > 0) = count(*) AS ready FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source""")
def channel_readiness(spark, d):
    """Whether all documents of a source are in both channels."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("in_dense"))
    rows = table(spark, d, "documents").select("source", "doc_id", (F.length("text") > 0).alias("in_lexical")).join(e, "doc_id", "left")
    both = F.count_if(F.col("in_lexical") & F.col("in_dense").isNotNull())
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("in_dense").alias("dense"), F.count_if("in_lexical").alias("lexical"), (both == F.count(F.lit(1))).alias("ready"))


@query("""SELECT doc_id, coalesce(CASE WHEN vec_id IS NOT NULL THEN sha1('vector ' || vec_id) END, sha1(source || chr(10) || text)) AS key, length(source || chr(10) || text) AS size FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def search_inputs(spark, d):
    """What is embedded (prefix and body), and its key in the cache: the embedding's hash where there is one, else the content's."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.sha1(F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("vector"))
    text = F.concat("source", F.lit("\n"), "text")
    return table(spark, d, "documents").select("doc_id", F.sha1(text).alias("content"), F.length(text).cast("long").alias("size")).join(e, "doc_id", "left").select("doc_id", F.coalesce("vector", "content").alias("key"), "size")


_KINDS = "CASE WHEN v IS NULL THEN 0 WHEN regexp_full_match(v, '[+-]?[0-9]{1,18}') THEN 1 WHEN regexp_full_match(v, '[+-]?[0-9]*[.]?[0-9]+') THEN 2 WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 3 ELSE 4 END"


@query(f"""WITH c AS (UNPIVOT (SELECT l_partkey::VARCHAR AS part, replace(l_quantity::DECIMAL(12, 2)::VARCHAR, '.00', '') AS quantity, l_tax::DECIMAL(12, 2)::VARCHAR AS tax, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_linestatus AS status FROM lineitem) ON part, quantity, tax, shipped, status INTO NAME name VALUE v),
  k AS (SELECT name, {_KINDS} AS kind FROM c) SELECT name, CASE WHEN bool_and(kind <= 1) THEN 'long' WHEN bool_and(kind <= 2) THEN 'double' WHEN bool_and(kind IN (0, 3)) THEN 'date' ELSE 'string' END AS kind, count(*) AS cells FROM k GROUP BY name""")
def inferred_schema(spark, d):
    """The narrowest type that all of a column's raw cells fit, in one pass over all columns."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("part"), F.replace(F.col("l_quantity").cast("decimal(12,2)").cast("string"), F.lit(".00"), F.lit("")).alias("quantity"), F.col("l_tax").cast("decimal(12,2)").cast("string").alias("tax"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), F.col("l_linestatus").alias("status"),
    )

    def flags(name: str):
        v = F.col(name)
        kind = F.when(v.isNull(), 0).when(v.rlike("^[+-]?[0-9]{1,18}$"), 1).when(v.rlike("^[+-]?[0-9]*[.]?[0-9]+$"), 2).when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), 3).otherwise(4)
        found = F.when(F.every(kind <= 1), "long").when(F.every(kind <= 2), "double").when(F.every(kind.isin(0, 3)), "date").otherwise("string")
        return F.struct(F.lit(name).alias("name"), found.alias("kind"), F.count(F.lit(1)).alias("cells"))

    return rows.agg(F.array(*map(flags, rows.columns)).alias("x")).select(F.inline("x"))


@query("""WITH q AS (SELECT unnest(string_split(lower(p_name), ' ')) AS term FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)), q2 AS (SELECT DISTINCT term FROM q), r AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part),
  f AS (SELECT term, count(*) AS freq FROM r JOIN q2 ON list_contains(w, term) GROUP BY term), s AS (SELECT p_partkey, p_brand, round(sum(1.0 / freq), 9) AS score FROM r JOIN f ON list_contains(w, term) GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY score, p_brand ORDER BY p_partkey) AS turn FROM s) SELECT p_partkey, p_brand, round(score, 6) AS score FROM o ORDER BY o.score DESC, turn, p_brand LIMIT 6""")
def table_row_search(spark, d):
    """The six rows that hold the rarest of a question's terms; rows of equal score are taken from the sheets in turn."""
    p = table(spark, d, "part")
    rows = p.select("p_partkey", "p_brand", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("term"))
    asked = p.orderBy("p_partkey").limit(1).select(F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("term"))
    met = rows.join(F.broadcast(asked), "term")  # one question's terms
    freq = met.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    scored = met.join(F.broadcast(freq), "term").groupBy("p_partkey", "p_brand").agg(F.round(F.sum(1 / F.col("freq")), 9).alias("score"))
    turn = F.row_number().over(Window.partitionBy("score", "p_brand").orderBy("p_partkey"))
    return scored.withColumn("turn", turn).filter("turn <= 6").orderBy(F.desc("score"), "turn", "p_brand").limit(6).select("p_partkey", "p_brand", F.round("score", 6).alias("score"))


_CHANGED = "(SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, source, lang, text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0)"


@query("WITH " + bm25_sql().replace("FROM documents)", f"FROM {_CHANGED})", 1) + " SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25_after_update(spark, d):
    """Search after documents left the stored postings and came back under new ids: lengths, totals and frequencies follow."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    gone = docs.filter("doc_id % 5 = 0 OR doc_id % 3 = 0").select(F.col("doc_id").alias("doc"))
    came = docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000)
    path = postings.update(spark, store(spark, d), gone, came, shared(spark))
    return postings.search(spark, path, TERMS, 20).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""WITH r AS (SELECT s_nationkey AS src, n_regionkey + 100 AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT c_nationkey, c_nationkey FROM customer UNION ALL SELECT n_regionkey + 100, n_nationkey FROM nation),
  e AS (SELECT src AS element, dst AS other, 'out' AS way FROM r UNION ALL SELECT dst, src, 'in' FROM r), l AS (SELECT c_nationkey AS element, max(o_orderdate) AS latest, count(*) AS imports FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
  SELECT n_nationkey AS element, n_name AS name, strftime(latest, '%Y-%m-%d') AS latest, coalesce(imports, 0) AS imports, count(*) FILTER (way = 'out') AS outgoing, count(*) FILTER (way = 'in') AS incoming
  FROM nation LEFT JOIN l ON l.element = n_nationkey LEFT JOIN e ON e.element = n_nationkey GROUP BY ALL""")
def element_context(spark, d):
    """Graph elements with their latest import and the numbers of relations that leave and reach them."""
    n, s, c = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "customer")
    up = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))
    loop = c.select(F.col("c_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    down = n.select((F.col("n_regionkey") + 100).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    edges = up.union(loop).union(down)
    ways = edges.groupBy(F.col("src").alias("element")).agg(F.count(F.lit(1)).alias("outgoing")).join(edges.groupBy(F.col("dst").alias("element")).agg(F.count(F.lit(1)).alias("incoming")), "element", "full")
    latest = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("element")).agg(F.max("o_orderdate").alias("latest"), F.count(F.lit(1)).alias("imports"))
    rows = n.select(F.col("n_nationkey").alias("element"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("key"))
    found = rows.join(latest.withColumnRenamed("element", "key"), "key", "left").join(ways.withColumnRenamed("element", "key"), "key", "left")
    zero = F.lit(0).cast("long")
    return found.select("element", "name", F.date_format("latest", "yyyy-MM-dd").alias("latest"), F.coalesce("imports", zero).alias("imports"), F.coalesce("outgoing", zero).alias("outgoing"), F.coalesce("incoming", zero).alias("incoming"))


_PATTERNS = ((r"!\[\]\(data:image/[^)]*\)", ""), (r"<a\s+id=\"[^\"]+\"></a>", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"\\([.()\\\-\[\]])", r"\1"), (r"[ \t]+\n", "\n"), (r"\n{4,}", "\n\n\n"), (r"^\s+|\s+$", ""))
_MARKED = "replace(replace(text, '. ', '.<br/>**<BR >** '), 'the ', '[the](x.y)\\.  <a id=\"k\"></a>')"


def _plain_sql(text: str) -> str:
    for pattern, put in _PATTERNS:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '(?i)<br\s*/?>', ' ', 'g'), '\*\*\s*\*\*', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g')) AS unbroken, md5({_plain_sql("t")}) AS plain FROM (SELECT doc_id, {_MARKED} AS t FROM documents WHERE contains(text, '. '))""")
def clean_passages(spark, d):
    """Passages that are marked up with line breaks, links, anchors and escapes, cleaned in both ways."""
    marked = F.replace(F.replace("text", F.lit(". "), F.lit(".<br/>**<BR >** ")), F.lit("the "), F.lit('[the](x.y)\\.  <a id="k"></a>'))
    rows = table(spark, d, "documents").filter(F.contains("text", F.lit(". "))).select("doc_id", marked.alias("t"))
    return rows.select("doc_id", F.md5(X.without_breaks(F.col("t"))).alias("unbroken"), F.md5(X.plain_markdown(F.col("t"))).alias("plain"))


@query("""SELECT p_partkey, nullif(CASE p_partkey % 5 WHEN 0 THEN p_size || '.' || p_partkey || '.2016' WHEN 1 THEN p_partkey || '.' || p_size WHEN 2 THEN p_size || '.1' ELSE '' END, '') AS number FROM part""")
def document_numbers(spark, d):
    """Numbers of standards in file names of five forms, of which two hold none."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    form = F.col("p_partkey") % 5
    name = F.when(form == 0, F.concat(F.lit("Файл СП "), n, F.lit("."), k, F.lit(".2016 ред.pdf"))).when(form == 1, F.concat(F.lit("гост р "), k, F.lit("."), n, F.lit("-х"))).when(form == 2, F.concat(F.lit("СНиП"), n, F.lit(".1_a")))
    name = name.when(form == 3, F.concat(F.lit("СП "), n)).otherwise(F.concat(F.lit("КСП 1."), n))
    return table(spark, d, "part").select("p_partkey", X.document_number(name).alias("number"))


@query("""WITH s AS (SELECT label, e.vec_id % 5 AS file, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 9) AS score FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) q),
  g AS (SELECT *, row_number() OVER (PARTITION BY label, file ORDER BY score DESC, vec_id) AS nth FROM s) SELECT label, file, vec_id, round(score, 6) AS score FROM g WHERE nth <= 2""")
def dense_by_dataset(spark, d):
    """One search of a question in every dataset, with two hits of each of its files."""
    e = table(spark, d, "embeddings")
    score = F.round(vectors.cosine(F.col("embedding"), F.array(*map(F.lit, vectors.query_vector(e, 0)))), 9)
    rows = e.select("label", (F.col("vec_id") % 5).alias("file"), "vec_id", score.alias("score"))
    nth = F.row_number().over(Window.partitionBy("label", "file").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("nth", nth).filter("nth <= 2").select("label", "file", "vec_id", F.round("score", 6).alias("score"))


def _longest(text: str, *groups: str) -> str:
    return f"regexp_extract({text}, '{SB.pattern(*groups)}')"


def _after(text: str, groups: tuple[str, str]) -> str:
    """The longest ending of both groups; one of the first counts only after а or я."""
    first = ", ".join(f"'{e}'" for e in groups[0].split())
    return f"CASE WHEN {_longest(text, *groups)} IN ({first}) AND NOT regexp_matches(left({text}, length({text}) - length({_longest(text, *groups)})), '[ая]$') THEN '' ELSE {_longest(text, *groups)} END"


@query(f"""WITH t AS (SELECT translate(w, '{LATIN}', '{CYRILLIC}') AS word, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest({TOK.format('text')}) AS w FROM documents) GROUP BY w)),
  a AS (SELECT *, replace(word, 'ё', 'е') AS w, regexp_extract(replace(word, 'ё', 'е'), '^[^{SB.VOWELS}]*[{SB.VOWELS}](.*)$', 1) AS rv, regexp_extract(replace(word, 'ё', 'е'), '^.*?[{SB.VOWELS}][^{SB.VOWELS}].*?[{SB.VOWELS}][^{SB.VOWELS}](.*)$', 1) AS r2 FROM t),
  b AS (SELECT *, {_after('rv', SB.GERUND)} AS g, regexp_replace(rv, '{SB.pattern(SB.REFLEXIVE)}', '') AS p FROM a), c AS (SELECT *, {_longest('p', SB.ADJECTIVE)} AS j, {_after('p', SB.VERB)} AS v, {_longest('p', SB.NOUN)} AS o, left(p, length(p) - length({_longest('p', SB.ADJECTIVE)})) AS l FROM b),
  d AS (SELECT *, CASE WHEN g <> '' THEN left(rv, length(rv) - length(g)) WHEN j <> '' THEN left(l, length(l) - length({_after('l', SB.PARTICIPLE)})) WHEN v <> '' THEN left(p, length(p) - length(v)) ELSE left(p, length(p) - length(o)) END AS x FROM c),
  e AS (SELECT *, regexp_replace(x, 'и$', '') AS y FROM d), f AS (SELECT *, CASE WHEN {_longest('y', SB.DERIVATIONAL)} <> '' AND length(y) - length({_longest('y', SB.DERIVATIONAL)}) >= length(rv) - length(r2) THEN left(y, length(y) - length({_longest('y', SB.DERIVATIONAL)})) ELSE y END AS z FROM e),
  h AS (SELECT word, n, CASE WHEN NOT regexp_full_match(word, '[а-яё]+') THEN word ELSE left(w, length(w) - length(rv)) || CASE WHEN regexp_matches(z, '{SB.pattern(SB.SUPERLATIVE)}') THEN regexp_replace(regexp_replace(z, '{SB.pattern(SB.SUPERLATIVE)}', ''), 'нн$', 'н') WHEN regexp_matches(z, 'нн$') THEN left(z, length(z) - 1) ELSE regexp_replace(z, 'ь$', '') END END AS stem FROM f)
  SELECT stem, sum(n)::BIGINT AS n, count(*) AS words FROM h GROUP BY stem""")
def snowball_stems(spark, d):
    """Words by their Snowball stem; every distinct word is stemmed once."""
    return SB.stem_counts(table(spark, d, "documents"), F.translate("w", LATIN, CYRILLIC))

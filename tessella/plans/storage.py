"""Queries that change stored tables, read records and outlines, and follow messages and states, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import storage as S
from tessella.operators import structure as D
from tessella.plans.base import query, table
from tessella.sources import files


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS total FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def upsert_rows(spark, d):
    """Orders as writes to a customer's row: the last one stays."""
    kept = S.upserted(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return kept.select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("total"))


@query("""WITH n AS (SELECT doc_id, source, lang FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE source IN ('src1', 'src2', 'src3')) SELECT doc_id, source, lang FROM documents WHERE source NOT IN (SELECT source FROM n) OR source IS NULL UNION ALL SELECT * FROM n""")
def replace_scope(spark, d):
    """Three sources are replaced by their documents of good quality."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return S.replaced_scopes(docs, docs.filter(F.col("source").isin("src1", "src2", "src3")).join(good, "doc_id", "left_semi"), ["source"])


@query("""WITH n AS (SELECT vec_id AS id, (label + 1) % 10 AS label FROM embeddings WHERE label IN (2, 3) UNION ALL SELECT vec_id, label FROM embeddings WHERE label = 5) SELECT n.id FROM n JOIN embeddings e ON e.vec_id = n.id WHERE n.label <> e.label""")
def scope_conflicts(spark, d):
    """Vectors that arrive under another label than the stored one."""
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    moved = stored.filter("label IN (2, 3)").select("id", ((F.col("label") + 1) % 10).alias("label")).unionByName(stored.filter("label = 5"))
    return S.scope_conflicts(stored, moved, "id", ["label"])


@query("""SELECT doc_id, source, n_chars FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)""")
def delete_rows(spark, d):
    gone = table(spark, d, "labels").filter("toxic = 1")
    return S.without(table(spark, d, "documents").select("doc_id", "source", "n_chars"), gone, ["doc_id"])


@query("""WITH s AS (SELECT source AS collection, doc_id, lang FROM documents), p AS (SELECT * FROM s WHERE collection IS DISTINCT FROM 'src2' UNION ALL SELECT 'src2', doc_id, lang FROM s WHERE collection = 'src1') SELECT collection, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT lang) AS langs FROM p GROUP BY collection""")
def promote_collection(spark, d):
    """The documents of src2 are exchanged for a copy of those of src1."""
    stored = table(spark, d, "documents").select(F.col("source").alias("collection"), "doc_id", "lang")
    return S.promoted(stored, "src1", "src2").groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.countDistinct("lang").alias("langs"))


@query("""SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_type AS kind FROM events""")
def payload_update(spark, d):
    """Event properties get the event's type and lose k for errors."""
    new = S.payload_set(F.from_json("props", "map<string,string>"), {"kind": F.col("event_type"), "k": F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k"))})
    return table(spark, d, "events").select("event_id", "user_id", new.alias("p")).select("event_id", "user_id", F.col("p")["k"].alias("k"), F.col("p")["kind"].alias("kind"))


@query("""SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS record FROM events""")
def json_records(spark, d):
    return table(spark, d, "events").select("event_id", files.record_text(F.col("props"), ("id", "name")).alias("record"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0), lambda a: lower(a)))), ',') AS addresses FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')""")
def mail_addresses(spark, d):
    found = table(spark, d, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", X.addresses(F.col("text")).alias("a"))
    return found.filter(F.size("a") > 0).select("doc_id", F.array_join("a", ",").alias("addresses"))


@query("""SELECT conv_id, turn, list_sort(list_distinct(list_concat(range(least(turn, 3), greatest(turn, 3) + 1), [turn + 10]))) AS n, len(list_filter(n, lambda x: x > 8)) AS unknown FROM conversations""".replace("SELECT conv_id, turn, ", "SELECT conv_id, turn, array_to_string(n, ',') AS cited, unknown FROM (SELECT conv_id, turn, ", 1) + ")")
def answer_citations(spark, d):
    """Turns with marks that their numbers give, one in code: which of eight sources are cited, how many marks name none."""
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), F.col("turn"), F.lit("-3, "), F.col("turn") + 10, F.lit("] `[99]`"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", X.citations(marked).alias("n"))
    return rows.select("conv_id", "turn", F.array_join(F.col("n").cast("array<string>"), ",").alias("cited"), F.size(F.filter("n", lambda x: x > 8)).alias("unknown"))


@query(r"""WITH t AS (SELECT doc_id, text, replace(substr(text, 1, 200), chr(10), '') AS head FROM documents) SELECT doc_id, coalesce(length(text) >= 40 AND (len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 60 AND NOT contains(x, ' ') AND contains(x, '/'))) >= 2
  OR (length(head) > 80 AND NOT regexp_matches(head, '[\x{0400}-\x{04ff}]') AND length(head) - length(replace(head, ' ', '')) < 3)), false) AS garbage FROM t""")
def binary_garbage(spark, d):
    return table(spark, d, "documents").select("doc_id", X.binary_garbage(F.col("text")).alias("garbage"))


#: Parts of a page: its title, its headings below it, and paragraphs, which stand under them.
_PARTS = "<(title|h[1-6]|p)>([^<]+)"
_LEVEL = "CASE WHEN tag = 'title' THEN 1 WHEN tag = 'p' THEN 9 ELSE substr(tag, 2)::INTEGER + 1 END"


@query(f"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '{_PARTS}', 1)) AS tag, unnest(regexp_extract_all(html, '{_PARTS}', 2)) AS title, unnest(range(len(regexp_extract_all(html, '{_PARTS}', 1)))) AS ord FROM pages), l AS (SELECT page_id, ord, title, {_LEVEL} AS level FROM m),
  o AS (SELECT *, max(CASE WHEN level = 1 THEN ord END) OVER w AS o1, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1, max(CASE WHEN level = 2 THEN ord END) OVER w AS o2, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2 FROM l WINDOW w AS (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
  SELECT page_id, ord, array_to_string(list_filter([t1, CASE WHEN o2 > coalesce(o1, -1) THEN t2 END], lambda x: x IS NOT NULL), ' > ') AS path FROM o""")
def heading_paths(spark, d):
    """Under which title and heading every paragraph of a page stands."""
    tags, titles = (F.regexp_extract_all("html", F.lit(_PARTS), F.lit(k)) for k in (1, 2))
    parts = table(spark, d, "pages").select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), titles.alias("title"))).alias("ord", "m"))
    level = F.when(F.col("m.tag") == "title", 1).when(F.col("m.tag") == "p", 9).otherwise(F.substring("m.tag", 2, 1).cast("int") + 1)
    return D.heading_paths(parts.select(F.col("page_id").alias("doc_id"), "ord", level.alias("level"), F.col("m.title").alias("title")), 7).select(F.col("doc_id").alias("page_id"), "ord", "path")


@query("""SELECT source, sha256(string_agg(doc_id || '|' || sha1(text), chr(10) ORDER BY doc_id)) AS signature, count(*) AS n FROM documents GROUP BY source""".replace("FROM documents", "FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 8)", 1))
def retrieval_signature(spark, d):
    """A digest of every source's eight longest documents, with their contents' digests, in order of id."""
    longest = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = table(spark, d, "documents").withColumn("_n", F.row_number().over(longest)).filter("_n <= 8")
    line = F.concat_ws("|", "doc_id", F.sha1("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"])
    return top.groupBy("source").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("signature"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS carriers, count(DISTINCT o_custkey) AS owners, min(l_orderkey) AS first_carrier FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) > 1""")
def attachment_provenance(spark, d):
    """Items that several carriers hold, with how many there are and of whom."""
    held = table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = held.groupBy(F.col("l_partkey").alias("item")).agg(F.countDistinct("l_orderkey").alias("carriers"), F.countDistinct("o_custkey").alias("owners"), F.min("l_orderkey").alias("first_carrier"))
    return out.filter("carriers > 1")


#: Allowed moves between states; F is final.
MOVES = {"O": ("P", "F"), "P": ("O", "F"), "F": ()}


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, o_orderstatus AS after, before = after OR (before || after) IN ('OP', 'OF', 'PO', 'PF') AS allowed FROM orders) WHERE before IS NOT NULL""")
def state_transitions(spark, d):
    """Moves between the states of a customer's consecutive orders, and whether they are allowed."""
    moves = [a + b for a, to in MOVES.items() for b in to]
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderstatus").over(order).alias("before"), F.col("o_orderstatus").alias("after")).filter("before IS NOT NULL")
    return rows.withColumn("allowed", (F.col("before") == F.col("after")) | F.concat("before", "after").isin(moves))


@query("""SELECT user_id, event_id, event_type, waiting FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS waiting FROM events) WHERE n = 1""")
def claim_next(spark, d):
    """A user's next job: errors first, then purchases, then others, the oldest of them; jobs are pre-aggregated, not sorted."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    first = F.min(F.struct(rank.alias("r"), "ts", "event_id", "event_type")).alias("j")
    return table(spark, d, "events").groupBy("user_id").agg(first, F.count(F.lit(1)).alias("waiting")).select("user_id", "j.event_id", "j.event_type", "waiting")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zäöüß]{5,}', 0)) AS word FROM conversations), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zäöüß]{5,}', 0)) AS alias FROM benchmark)
  SELECT word, count(*) AS aliases, min(alias) AS first_alias FROM w JOIN b ON substr(word, 1, 5) = substr(alias, 1, 5) WHERE starts_with(word, substr(alias, 1, greatest(5, length(alias) - 3))) OR starts_with(alias, substr(word, 1, greatest(5, length(word) - 3))) GROUP BY word""")
def expand_synonyms(spark, d):
    """Aliases of question words that agree up to their last three letters, in five at least: an equal join on five letters."""
    words = lambda name, c: table(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüß]{5,}"), F.lit(0))).alias(c)).distinct().withColumn(f"_{c}", F.substring(c, 1, 5))
    stem = lambda c: F.substring(F.col(c), F.lit(1), F.greatest(F.lit(5), F.length(c) - 3))
    met = words("conversations", "word").join(words("benchmark", "alias"), F.col("_word") == F.col("_alias"))
    met = met.filter(F.startswith("word", stem("alias")) | F.startswith("alias", stem("word")))
    return met.groupBy("word").agg(F.count(F.lit(1)).alias("aliases"), F.min("alias").alias("first_alias"))

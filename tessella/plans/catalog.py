"""Queries over catalog state, work lines, inventories and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import catalog as C
from tessella.operators import tables as T
from tessella.plans.base import query, table

LINES = "lineitem JOIN part ON l_partkey = p_partkey"


def lines(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


@query("""SELECT doc_id, source, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 ORDER BY coalesce(quality, 0) = 1, nullif(n_chars, 0) NULLS LAST, doc_id LIMIT 64""")
def pending_batch(spark, d):
    """The next 64 documents: those without a good label first, small ones first, empty ones last."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
    return rows.orderBy(F.coalesce("quality", F.lit(0)) == 1, F.nullif("n_chars", F.lit(0)).asc_nulls_last(), "doc_id").limit(64).select("doc_id", "source", "n_chars")


@query("""SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS done, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (quality IS NULL) AS waiting, round(count(*) FILTER (quality IS NOT NULL) / count(*), 6) AS progress FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def progress_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("done"), F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("quality").isNull()).alias("waiting"), F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("progress"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_totalprice AS size, o_custkey AS mtime FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size, CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 5 ELSE o_custkey END AS mtime FROM orders WHERE o_orderkey % 11 <> 0)
  SELECT coalesce(s.id, n.id) AS id, n.id IS NOT NULL AND (s.id IS NULL OR s.size <> n.size OR abs(s.mtime - n.mtime) >= 1) AS changed, n.id IS NULL AS missing FROM s FULL JOIN n ON s.id = n.id""")
def folder_watch(spark, d):
    """A watch list and a later scan, both derived from orders."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("size"), F.col("o_custkey").alias("mtime"))
    state = o.filter("id % 7 <> 0").withColumn("missing", F.lit(False))
    seen = o.filter("id % 11 <> 0").select("id", F.when(F.col("id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("id") % 17 == 0, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"))
    return C.watched(state, seen, complete=True).select("id", "changed", "missing")


@query("""WITH RECURSIVE u AS (SELECT conv_id * 1000 + turn AS id, regexp_matches(text, '[0-9]{3}') AS changed FROM conversations), e AS (SELECT a.id, a.id - 1 AS dep FROM u a WHERE a.id % 1000 > 0),
  s AS (SELECT id FROM u WHERE changed UNION SELECT id FROM e WHERE dep NOT IN (SELECT id FROM u) UNION SELECT e.id FROM e JOIN s ON e.dep = s.id) SELECT id, id IN (SELECT id FROM s) AS needs_recheck FROM u""")
def review_state(spark, d):
    """Turns that need another look since they, or one that they build on, hold a long number."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").rlike("[0-9]{3}").alias("changed"))
    return C.stale_closure(c, c.filter("id % 1000 > 0").select("id", (F.col("id") - 1).alias("on")))


@query("""WITH e AS (SELECT user_id, event_type AS status, struct_pack(ts := ts, event_id := event_id) AS o FROM events) SELECT user_id, coalesce(min_by(status, o) FILTER (status IN ('purchase', 'error')), max_by(status, o)) AS status, count(*) AS events FROM e GROUP BY user_id""")
def job_states(spark, d):
    """Event types as a user's job: the first purchase or error is final."""
    return C.job_states(table(spark, d, "events"), "user_id", F.col("event_type"), F.struct("ts", "event_id"), ["purchase", "error"])


@query("""SELECT event_id, user_id FROM events WHERE ts + INTERVAL 6 HOUR > (SELECT max(ts) FROM events)""")
def session_ttl(spark, d):
    """Events that are under six hours old at the time of the newest one."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(newest), F.col("ts") + F.expr("INTERVAL 6 HOURS") > F.col("now")).select("event_id", "user_id")


@query("""WITH f AS (SELECT conv_id, min_by(text, turn) AS question, min(turn) AS started, max(turn) AS ended FROM conversations GROUP BY conv_id) SELECT conv_id, question, started, ended FROM f WHERE conv_id NOT IN (SELECT item_id FROM benchmark)""")
def legacy_sessions(spark, d):
    """Conversations that aren't registered, with their first turn's text."""
    found = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.min("turn").alias("started"), F.max("turn").alias("ended"))
    return found.join(table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id")), "conv_id", "left_anti").select("conv_id", "question", "started", "ended")


@query("""WITH a AS (SELECT doc_id AS id, n_chars AS expected FROM documents), b AS (SELECT vec_id AS id, len(embedding) AS dims FROM embeddings) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'orphan' WHEN b.id IS NULL THEN 'requeue' WHEN expected < dims THEN 'requeue' ELSE 'match' END AS state FROM a FULL JOIN b ON a.id = b.id""")
def reconcile_counts(spark, d):
    """Catalog counts against stored points: what has to be indexed again."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("expected"), F.lit(True).alias("here"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("dims"))
    state = F.when(F.col("here").isNull(), "orphan").when(F.col("dims").isNull() | (F.col("expected") < F.col("dims")), "requeue").otherwise("match")
    return a.join(b, "id", "full").select("id", state.alias("state"))


@query("""SELECT doc_id, source FROM documents d WHERE contains(lower(text), 'the') AND contains(lower(text), 'our') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def explorer_search(spark, d):
    """Documents with all words in any form, without those that are marked."""
    found = table(spark, d, "documents").withColumn("_t", F.lower("text")).filter(F.contains("_t", F.lit("the")) & F.contains("_t", F.lit("our")))
    return found.select("doc_id", "source").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_anti")


@query("""SELECT c_nationkey, kind, count(*) AS links, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM (SELECT c_nationkey, c_mktsegment AS kind, c_custkey FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_suppkey FROM supplier) GROUP BY ALL""")
def edge_backlinks(spark, d):
    """Typed edges into every nation."""
    a = table(spark, d, "customer").select("c_nationkey", F.col("c_mktsegment").alias("kind"), "c_custkey")
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("c_custkey"))
    return a.unionByName(b).groupBy("c_nationkey", "kind").agg(F.count(F.lit(1)).alias("links"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


@query("""SELECT o_custkey, l_suppkey, min(l_orderkey) AS first_order, round(sum(l_quantity), 4) AS qty, count(*) AS relations FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def relation_dedup(spark, d):
    """Relations between customers and suppliers once each, with the first order that states one."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_custkey", "l_suppkey").agg(F.min("l_orderkey").alias("first_order"), F.round(F.sum("l_quantity"), 4).alias("qty"), F.count(F.lit(1)).alias("relations"))


RULES = [("supply", "steel"), ("mount", "small"), ("mount", "medium"), ("test", "brass"), ("test", "promo")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_type), '{h}') THEN '{f}'" for f, h in RULES) + " ELSE 'other' END AS field FROM part")
def map_columns(spark, d):
    """The field of the first rule whose hint a label holds."""
    return table(spark, d, "part").select("p_partkey", F.coalesce(T.mapped(F.col("p_type"), RULES), F.lit("other")).alias("field"))


KINDS = {"metal": ["steel", "brass", "copper", "tin", "nickel"], "size": ["small", "medium", "large"], "finish": ["plated", "polished", "brushed", "burnished", "anodized"]}


@query("SELECT p_partkey, CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN a >= b AND a >= c THEN 'metal' WHEN b >= c THEN 'size' ELSE 'finish' END AS kind FROM (SELECT p_partkey, " + ", ".join(
    " + ".join(f"contains(lower(p_name || ' ' || p_type), '{h}')::INT" for h in hints) + f" AS {n}" for n, hints in zip("abc", KINDS.values(), strict=True)) + " FROM part)")
def detect_kind(spark, d):
    """The kind with the most hints, of equals the first."""
    return table(spark, d, "part").select("p_partkey", F.coalesce(T.kind(F.concat_ws(" ", "p_name", "p_type"), KINDS), F.lit("unknown")).alias("kind"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT p_partkey AS number, p_partkey AS rest, CASE WHEN p_partkey IS NOT NULL THEN '' END AS letters FROM part
    UNION ALL SELECT number, (rest - 1) // 26, chr(65 + ((rest - 1) % 26)::INT) || letters FROM c WHERE rest > 0)
  SELECT number, letters, number::INTEGER AS again FROM c WHERE rest <= 0 OR rest IS NULL""")
def a1_columns(spark, d):
    """Spreadsheet columns by number, as letters and back."""
    letters = X.column_letters(F.col("number"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("number")).distinct().withColumn("letters", letters).withColumn("again", X.column_number(F.col("letters")))


@query("""SELECT l_returnflag AS sheet, max(l_orderkey) AS last_row, max(l_linenumber) AS last_col, chr(64 + max(l_linenumber)) AS last_letters, count(*) AS cells, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY l_returnflag""")
def workbook_describe(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sheet")).agg(F.max("l_orderkey").alias("last_row"), F.max("l_linenumber").alias("last_col"), F.count(F.lit(1)).alias("cells"), F.round(F.sum("l_quantity"), 4).alias("total"))
    return a.withColumn("last_letters", X.column_letters(F.col("last_col")))


@query(f"""SELECT p_brand, p_size, max_by(p_name, struct_pack(n := length(p_name), s := p_name)) AS name, round(sum(coalesce(nullif(l_quantity, 0), l_extendedprice)), 4) AS qty, count(*) AS rows FROM {LINES} GROUP BY ALL""")
def aggregate_positions(spark, d):
    """Positions by mark and size: the first known quantity of each row, summed, under the longest name."""
    rows = lines(spark, d).groupBy("p_brand", "p_size")
    return rows.agg(F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("name"), F.round(F.sum(F.coalesce(F.nullif("l_quantity", F.lit(0.0)), "l_extendedprice")), 4).alias("qty"), F.count(F.lit(1)).alias("rows"))


@query(f"""SELECT CASE WHEN contains(lower(p_type), 'plated') THEN 'coat' WHEN contains(lower(p_type), 'polished') THEN 'polish' ELSE 'mount' END AS work, p_brand, count(*) AS lines, round(sum(l_quantity), 4) AS qty FROM {LINES} GROUP BY ALL""")
def work_lines(spark, d):
    """Specification lines as work, by the first verb rule that fits."""
    work = F.coalesce(T.mapped(F.col("p_type"), [("coat", "plated"), ("polish", "polished")]), F.lit("mount"))
    return lines(spark, d).groupBy(work.alias("work"), "p_brand").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 4).alias("qty"))


@query("""SELECT l_partkey, l_returnflag AS unit, round(sum(l_quantity), 4) AS volume, count(*) AS entries FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL""")
def aggregate_volumes(spark, d):
    """Accepted volumes of a period by position and unit."""
    rows = table(spark, d, "lineitem").filter("l_linestatus = 'F' AND l_shipdate >= TIMESTAMP_NTZ '1994-01-01' AND l_shipdate < TIMESTAMP_NTZ '1998-01-01'")
    return rows.groupBy("l_partkey", F.col("l_returnflag").alias("unit")).agg(F.round(F.sum("l_quantity"), 4).alias("volume"), F.count(F.lit(1)).alias("entries"))


@query("""WITH g AS (SELECT l_suppkey, l_returnflag, sum(l_quantity::DECIMAL(38,12)) AS q FROM lineitem GROUP BY ALL) SELECT l_suppkey, string_agg(l_returnflag || '=' || q::DECIMAL(38,2), ';' ORDER BY l_returnflag) AS totals, sum(q)::VARCHAR AS total FROM g GROUP BY l_suppkey""")
def grouped_inventory(spark, d):
    """Totals of every supplier, nested by role."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast(T.EXACT)).cast(T.EXACT).alias("q"))
    entry = F.concat_ws("=", "l_returnflag", F.col("q").cast("decimal(38,2)").cast("string"))
    return g.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list(entry)), ";").alias("totals"), F.sum("q").cast(T.EXACT).cast("string").alias("total"))


@query("""WITH r AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS nth FROM r), a AS (SELECT l_partkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS refs FROM n WHERE nth <= 8 GROUP BY l_partkey), q AS (SELECT l_partkey, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY l_partkey)
  SELECT p_partkey, a.refs IS NOT NULL AS matched, coalesce(refs, '') AS refs, qty FROM part LEFT JOIN a ON p_partkey = a.l_partkey LEFT JOIN q ON p_partkey = q.l_partkey""")
def load_material_join(spark, d):
    """Every part with its quantity and at most eight orders that name it."""
    li = table(spark, d, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey"))
    refs = li.select("l_partkey", "l_orderkey").distinct().withColumn("nth", nth).filter("nth <= 8").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_list("l_orderkey")), ",").alias("refs"))
    sums = li.groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 4).alias("qty"))
    joined = table(spark, d, "part").select("p_partkey").join(refs.join(sums, "l_partkey", "full"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select("p_partkey", F.col("refs").isNotNull().alias("matched"), F.coalesce("refs", F.lit("")).alias("refs"), "qty")


@query("""SELECT a AS address, CASE WHEN regexp_matches(a, '^10\\.') THEN true ELSE false END AS inside, count(*) AS rows FROM (SELECT (c_nationkey % 20)::VARCHAR || '.' || (c_custkey % 256) || '.1.7' AS a FROM customer) GROUP BY ALL""".replace("\\\\", "\\"))
def ip_in_networks(spark, d):
    """Addresses made of customer keys that lie in 10.0.0.0/8."""
    address = F.concat(F.col("c_nationkey") % 20, F.lit("."), F.col("c_custkey") % 256, F.lit(".1.7"))
    return table(spark, d, "customer").groupBy(address.alias("address")).agg(F.count(F.lit(1)).alias("rows")).withColumn("inside", C.in_network(F.col("address"), "10.0.0.0/8"))

"""Queries over tables, catalogs, graphs and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import tables as T
from tessella.plans.base import query, table


@query("""SELECT l_returnflag, sum(l_extendedprice::VARCHAR::DECIMAL(38,12))::VARCHAR AS exact_total, count(l_extendedprice) AS counted, count(*) - count(l_extendedprice) AS missing, count(*) = count(l_extendedprice) AS complete FROM lineitem GROUP BY l_returnflag""")
def exact_sum(spark, d):
    return T.exact_sum(table(spark, d, "lineitem"), F.col("l_extendedprice"), "l_returnflag").withColumn("exact_total", F.col("exact_total").cast("string"))


@query("""SELECT p_type AS section, p_name AS name, p_brand AS mark, round(sum(l_quantity), 6) AS qty, count(*) FILTER (l_quantity IS NULL) AS missing, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS sources
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def build_bor(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("p_type").alias("section"), F.col("p_name").alias("name"), F.col("p_brand").alias("mark"), "l_quantity", "l_returnflag")
    return T.quantities(rows, ["section", "name", "mark"], "l_quantity", "l_returnflag")


@query("""WITH p AS (SELECT p_name AS name, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name)
  SELECT *, CASE WHEN (A IS NOT NULL)::INT + (N IS NOT NULL)::INT + (R IS NOT NULL)::INT > 1 AND greatest(A, N, R) - least(A, N, R) > greatest(1e-6, greatest(A, N, R) * 0.01) THEN 'mismatch' WHEN A IS NULL OR N IS NULL OR R IS NULL THEN 'gap' ELSE 'match' END AS status FROM p""")
def reconcile_pivot(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_name", "name")
    return T.reconcile(rows, ["name"], "l_returnflag", ["A", "N", "R"], "l_quantity")


@query("""SELECT p_brand, p_type, count(*) AS quotes, count(DISTINCT l_suppkey) AS suppliers, min(net) AS low, max(net) AS high, round(median(net), 6) AS median, round((max(net) - min(net)) / nullif(min(net), 0) * 100, 4) AS spread_pct, count(DISTINCT l_suppkey) >= 3 AS sufficient
  FROM (SELECT *, round(l_extendedprice / l_quantity / (1 + l_tax), 6) AS net FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL""")
def price_analysis(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return T.price_analysis(rows, ["p_brand", "p_type"], F.col("l_extendedprice") / F.col("l_quantity") / (1 + F.col("l_tax")), "l_suppkey")


@query("""WITH c AS (SELECT l_orderkey AS r, l_linenumber AS c, l_quantity AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS nth FROM lineitem) WHERE nth = 1)
  SELECT name, sum(value::DECIMAL(38,12))::VARCHAR AS total, count(value) AS cells FROM c, (VALUES ('A1:C100', 1, 100, 1, 3), ('B50:B5000', 50, 5000, 2, 2), ('A1:G9999', 1, 9999, 1, 7)) AS q(name, r1, r2, c1, c2) WHERE r BETWEEN r1 AND r2 AND c BETWEEN c1 AND c2 GROUP BY name""")
def range_sum(spark, d):
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    cells = table(spark, d, "lineitem").withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c"), F.col("l_quantity").alias("value"))
    ranges = spark.createDataFrame([("A1:C100",), ("B50:B5000",), ("A1:G9999",)], "name string")
    part = F.regexp_extract_all("name", F.lit(r"([A-Z]+)([0-9]+)"), F.lit(1)), F.regexp_extract_all("name", F.lit(r"([A-Z]+)([0-9]+)"), F.lit(2))
    bounds = ranges.select("name", *(X.column_number(part[0][i]).alias(f"c{i + 1}") for i in (0, 1)), *(part[1][i].cast("int").alias(f"r{i + 1}") for i in (0, 1)))
    return T.cell_ranges(cells, bounds).withColumn("total", F.col("total").cast("string"))


@query("""WITH r AS (SELECT p_partkey, list_contains(w, 'red') AS a, list_contains(w, 'steel') AS b FROM (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[0-9a-z]+', 0) AS w FROM part)), s AS (SELECT count(*) AS n, count(*) FILTER (a) AS fa, count(*) FILTER (b) AS fb FROM r)
  SELECT p_partkey, round(CASE WHEN a THEN ln((n + 1) / (fa + 1)) + 1 ELSE 0 END + CASE WHEN b THEN ln((n + 1) / (fb + 1)) + 1 ELSE 0 END, 6) AS weight FROM r, s WHERE a OR b ORDER BY weight DESC, p_partkey LIMIT 16""")
def select_rows(spark, d):
    words = X.tokens(F.concat_ws(" ", "p_name", "p_type"))
    return T.row_search(table(spark, d, "part"), ["red", "steel"], words, ["p_partkey"], 16).select("p_partkey", F.round("weight", 6).alias("weight"))


@query("""SELECT p_brand AS "table", (row_number() OVER w)::INTEGER AS pos, CASE WHEN nth > 1 THEN header || '_' || nth ELSE header END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, header ORDER BY p_partkey) AS nth FROM (SELECT p_brand, p_partkey, trim(p_name) AS header FROM part)) WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)""")
def dup_headers(spark, d):
    pos = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return T.unique_headers(table(spark, d, "part").select(F.col("p_brand").alias("table"), pos.alias("pos"), F.col("p_name").alias("header")))


@query("""SELECT l_linestatus, l_returnflag, count(DISTINCT (l_orderkey, l_linenumber)) AS cells, sum(l_quantity::DECIMAL(38,12))::VARCHAR AS total, count(DISTINCT l_suppkey) > 1 AS unit_conflict FROM (SELECT DISTINCT * FROM lineitem) GROUP BY ALL""")
def table_facts(spark, d):
    rows = table(spark, d, "lineitem").distinct()
    return rows.groupBy("l_linestatus", "l_returnflag").agg(F.countDistinct("l_orderkey", "l_linenumber").alias("cells"), F.sum(F.col("l_quantity").cast(T.EXACT)).cast("string").alias("total"), (F.countDistinct("l_suppkey") > 1).alias("unit_conflict"))


@query("""SELECT d.source, d.lang, l.quality, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (l.toxic = 1) AS toxic, grouping(d.source)::INTEGER AS g_source, grouping(d.lang)::INTEGER AS g_lang FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY GROUPING SETS ((d.source), (d.lang), (l.quality))""")
def health_grouping_sets(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    sets = joined.groupingSets([["source"], ["lang"], ["quality"]], "source", "lang", "quality")
    return sets.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.grouping("source").cast("int").alias("g_source"), F.grouping("lang").cast("int").alias("g_lang"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS customers, count(DISTINCT c_nationkey) AS nations, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def backbone_rollup(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.countDistinct("c_nationkey").alias("nations"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


@query("""SELECT ext, count(*) AS pages, array_to_string(list_sort(list(DISTINCT lang))[1:6], ',') AS folders FROM (SELECT CASE WHEN contains(path, '.') THEN regexp_extract(path, '\\.([a-z]+)$', 1) ELSE '' END AS ext, split_part(path, '/', 2) AS lang FROM (SELECT regexp_extract(url, '^[^/]*//[^/]*([^?#]*)', 1) AS path FROM pages)) GROUP BY ext ORDER BY pages DESC, ext LIMIT 25""".replace("\\\\", "\\"))
def ext_histogram(spark, d):
    path = F.regexp_extract("url", r"^[^/]*//[^/]*([^?#]*)", 1)
    rows = table(spark, d, "pages").select(F.regexp_extract(path, r"\.([a-z]+)$", 1).alias("ext"), F.split_part(path, F.lit("/"), F.lit(2)).alias("lang"))
    return rows.groupBy("ext").agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.slice(F.sort_array(F.collect_set("lang")), 1, 6), ",").alias("folders")).orderBy(F.col("pages").desc(), "ext").limit(25)


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) ORDER BY nth > 1, n_chars DESC, doc_id LIMIT 50""")
def bounded_cards(spark, d):
    """Fifty cards: the largest document of every source first, then the largest others."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", "n_chars", nth.alias("nth")).orderBy(F.col("nth") > 1, F.col("n_chars").desc(), "doc_id").limit(50).select("doc_id", "source")


@query("""SELECT conv_id, min(turn) AS started, max(turn) AS ended, count(*) AS messages, min(text) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id""")
def sessions(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("started"), F.max("turn").alias("ended"), F.count(F.lit(1)).alias("messages"), F.min(F.when(F.col("role") == "user", F.col("text"))).alias("title"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS size FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice + 1 ELSE o_totalprice END AS size FROM orders WHERE o_orderkey % 11 <> 0)
  SELECT state, count(*) AS files FROM (SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.size <> b.size THEN 'updated' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.id = b.id) GROUP BY state""")
def snapshot_diff(spark, d):
    """Two snapshots derived from orders, compared: added, removed, updated, unchanged."""
    o = table(spark, d, "orders")
    a = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"))
    grown = F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    b = o.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), grown.alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "updated").otherwise("unchanged")
    return a.join(b, "id", "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING' WHEN l.toxic = 1 THEN 'ERROR' WHEN l.quality = 0 THEN 'STALE' ELSE 'INDEXED' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def stale_status(spark, d):
    status = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), "MISSING").when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "STALE").otherwise("INDEXED")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", status.alias("status"))


@query("""SELECT user_id, count(*) AS attempts, least(5 * pow(2, least(count(*), 20) - 1), 300)::DOUBLE AS wait_s FROM events WHERE event_type = 'click' GROUP BY user_id""")
def retry_backoff(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "events").filter("event_type = 'click'").groupBy("user_id").agg(n.alias("attempts"), F.least(5 * F.pow(F.lit(2.0), F.least(n, F.lit(20)) - 1), F.lit(300.0)).alias("wait_s"))


@query("""SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS kinds, min(turn) AS low, max(turn) AS high, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS dense FROM conversations GROUP BY conv_id""")
def dense_ordinals(spark, d):
    a = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("turn").alias("kinds"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    return a.withColumn("dense", (F.col("n") == F.col("kinds")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + 21600000000 AS b FROM events), g AS (SELECT *, a > max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM e) SELECT user_id, count(*) FILTER (gap) AS gaps FROM g GROUP BY user_id""")
def interval_gaps(spark, d):
    """Gaps between the six-hour intervals that a user's events cover."""
    w = Window.partitionBy("user_id").orderBy("a", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "events").withColumn("a", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.withColumn("gap", F.col("a") > F.max(F.col("a") + 21600000000).over(w)).groupBy("user_id").agg(F.count_if("gap").alias("gaps"))


@query("""SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1""")
def latest_events(spark, d):
    last = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return last.select("event_type", "user_id", "x.event_id", "x.value")


@query("""SELECT a.user_id, a.event_type, count(DISTINCT value) AS vals FROM events a GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def fact_conflicts(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.countDistinct("value").alias("vals")).filter("vals > 1")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_counts(spark, d):
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS nth FROM e)
  SELECT user_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started FROM s GROUP BY user_id, nth""")
def sessionized_events(spark, d):
    s = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("t", "6 hours")).agg(F.count(F.lit(1)).alias("events"), F.min("t").alias("m"))
    return s.select("user_id", "events", F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("""SELECT s_name AS src, n_name AS dst, 'located' AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, r_name, 'part_of' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_union(spark, d):
    n = table(spark, d, "nation")
    a = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"), F.lit("located").alias("kind"))
    return a.unionByName(n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("part_of").alias("kind")))


@query("""SELECT coalesce(d.doc_id, e.vec_id) AS id, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'orphan' WHEN len(e.embedding) <> 64 THEN 'damaged' ELSE 'clean' END AS state FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id""")
def integrity_audit(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("dims"))
    j = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("has")).join(e, "id", "full")
    return j.select("id", F.when(F.col("dims").isNull(), "missing").when(F.col("has").isNull(), "orphan").when(F.col("dims") != 64, "damaged").otherwise("clean").alias("state"))


@query("""SELECT doc_id, count(*) AS chunks, sum(length(c))::BIGINT AS chars, count(*) FILTER (length(trim(c)) = 0) AS empty, count(*) FILTER (length(c) BETWEEN 1 AND 119) AS short, count(*) FILTER (contains(c, '|')) AS table_like FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents) GROUP BY doc_id""")
def index_quality(spark, d):
    """Counts over a document's lines, taken inside the row."""
    lines = F.split("text", "\n")
    n = lambda f: F.size(F.filter(lines, f)).cast("long")
    chars = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return table(spark, d, "documents").select(
        "doc_id", F.size(lines).cast("long").alias("chunks"), chars.alias("chars"), n(lambda x: F.length(F.trim(x)) == 0).alias("empty"), n(lambda x: F.length(x).between(1, 119)).alias("short"), n(lambda x: F.contains(x, F.lit("|"))).alias("table_like")
    )


@query("""SELECT o_orderstatus, count(*) AS jobs, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY o_orderstatus""")
def latency_percentiles(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("jobs"), F.percentile("o_totalprice", F.lit(0.5)).alias("p50"), F.percentile("o_totalprice", F.lit(0.95)).alias("p95"))


@query("""SELECT json_extract_string(props, '$.k')::INTEGER AS k, event_type, count(*) AS n FROM events GROUP BY ALL""")
def task_row_status(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def missing_sources(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH u AS (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN 'ea' ELSE 'm' END AS unit, unnest(CASE WHEN p_size > 25 THEN ['supply', 'mount', 'test'] ELSE ['supply', 'mount'] END) AS work, p_type FROM part) SELECT p_type, work, unit, sum(p_size)::BIGINT AS qty FROM u GROUP BY ALL""")
def decompose_lines(spark, d):
    """Every part becomes two or three work lines, which are summed."""
    work = F.when(F.col("p_size") > 25, F.array(*map(F.lit, ("supply", "mount", "test")))).otherwise(F.array(*map(F.lit, ("supply", "mount"))))
    unit = F.when(F.col("p_size") % 2 == 0, "ea").otherwise("m")
    return table(spark, d, "part").select("p_type", F.explode(work).alias("work"), unit.alias("unit"), "p_size").groupBy("p_type", "work", "unit").agg(F.sum("p_size").alias("qty"))


_NAMES = "SELECT p_size % 5 AS unit, p_name AS name FROM part UNION SELECT p_size % 5, split_part(p_name, ' ', 2) FROM part WHERE p_size > 25"


@query(f"""WITH n AS ({_NAMES}) SELECT a.unit, a.name, arg_min(b.name, struct_pack(l := length(b.name), s := b.name)) AS item FROM n a JOIN n b ON a.unit = b.unit AND (a.name = b.name OR (length(b.name) >= 4 AND contains(a.name, b.name))) GROUP BY a.unit, a.name""")
def contained_names(spark, d):
    """Part names and the shortest name of the same unit that each one holds."""
    p = table(spark, d, "part").withColumn("unit", F.col("p_size") % 5)
    short = p.filter("p_size > 25").select("unit", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"))
    return T.contained_names(p.select("unit", F.col("p_name").alias("name")).unionByName(short), "unit", "name")


@query("""SELECT s_nationkey AS sheet, 2 AS header FROM supplier GROUP BY s_nationkey""")
def sheet_headers(spark, d):
    """Every nation's suppliers as a sheet: a title, a blank row, labels, then the suppliers."""
    s = table(spark, d, "supplier")
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    body = s.select(F.col("s_nationkey").alias("sheet"), (F.row_number().over(order) + 2).alias("r"), F.explode(F.array(F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("decimal(12,2)").cast("string"))).alias("value"))
    head = s.select(F.col("s_nationkey").alias("sheet")).distinct()
    title, blank = head.select("sheet", F.lit(0).alias("r"), F.lit("Suppliers").alias("value")), head.select("sheet", F.lit(1).alias("r"), F.lit(" ").alias("value"))
    labels = head.select("sheet", F.lit(2).alias("r"), F.explode(F.array(F.lit("key"), F.lit("name"), F.lit("balance"))).alias("value"))
    return T.header_rows(body.unionByName(title).unionByName(blank).unionByName(labels))


@query("""SELECT p_partkey, substr(concat_ws('; ', 'name: ' || p_name, 'brand: ' || p_brand, CASE WHEN p_size > 10 THEN 'size: ' || p_size END, 'type: ' || p_type), 1, 60) AS chunk FROM part""")
def row_texts(spark, d):
    fields = {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.when(F.col("p_size") > 10, F.col("p_size")), "type": F.col("p_type")}
    return table(spark, d, "part").select("p_partkey", T.row_text(fields, 60).alias("chunk"))


@query("""SELECT n_name, '# ' || n_name || chr(10) || string_agg('- ' || s_name, chr(10) ORDER BY s_name, s_suppkey) AS markdown FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def graph_markdown(spark, d):
    """Every nation's suppliers as a list below a heading."""
    held = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("s_name", "s_suppkey"))), lambda x: F.concat(F.lit("- "), x["s_name"]))
    return held.groupBy("n_name").agg(F.array_join(lines, "\n").alias("body")).select("n_name", F.concat(F.lit("# "), "n_name", F.lit("\n"), "body").alias("markdown"))


@query("""WITH s AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS anchor, max(value) OVER (PARTITION BY user_id, event_type) AS best FROM events),
  t AS (SELECT user_id, event_type FROM s WHERE anchor = 1 ORDER BY value DESC, event_id LIMIT 12) SELECT user_id, event_type, event_id, anchor FROM s JOIN t USING (user_id, event_type) WHERE anchor <= 2""")
def merged_anchors(spark, d):
    """Of the twelve groups with the best hits the two best hits each: groups are ranked after one aggregation."""
    order = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    hits = table(spark, d, "events").select("user_id", "event_type", "event_id", "value").withColumn("anchor", F.row_number().over(order)).filter("anchor <= 2")
    leaders = hits.filter("anchor = 1").orderBy(F.desc("value"), "event_id").limit(12).select("user_id", "event_type")
    return hits.join(F.broadcast(leaders), ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "anchor")

"""Queries over typed tables in revisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import documents as D, typed as T
from tessella.plans.base import kept, query, table

#: Orders as JSON rows of changing keys: whole and broken numbers, texts, texts that are numbers, flags, nulls, mixed kinds.
_JSON = """'{"id": ' || o_orderkey || ', "total": ' || CASE WHEN o_custkey % 2 = 0 THEN round(o_totalprice)::BIGINT::VARCHAR ELSE o_totalprice::DECIMAL(18, 2)::VARCHAR END || ', "status": "' || o_orderstatus || '", "open": ' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END
  || ', "rank": "' || substr(o_orderpriority, 1, 1) || ',5"' || CASE WHEN o_custkey % 3 = 0 THEN ', "note": null' ELSE '' END || CASE WHEN o_custkey % 5 = 0 THEN ', "odd": ' || o_custkey WHEN o_custkey % 5 = 1 THEN ', "odd": "x"' ELSE '' END || CASE WHEN o_custkey % 7 = 0 THEN ', "list": [1]' ELSE '' END || '}'"""
_SPARK_JSON = _JSON.replace("::BIGINT::VARCHAR", "").replace("round(o_totalprice)", "CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING)").replace("o_totalprice::DECIMAL(18, 2)::VARCHAR", "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING)")


def _rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(_SPARK_JSON).alias("json"))


@query(f"""WITH j AS (SELECT ({_JSON})::JSON AS j FROM orders), k AS (SELECT unnest(json_keys(j)) AS key, j FROM j), c AS (SELECT key, json_type(j, '$.' || key) AS t FROM k),
  f AS (SELECT key, bool_or(t IN ('UBIGINT', 'BIGINT')) AS i, bool_or(t = 'DOUBLE') OR (key = 'rank' AND bool_or(t = 'VARCHAR')) AS f, bool_or(t = 'VARCHAR') AND key <> 'rank' AS s, bool_or(t = 'BOOLEAN') AS b, bool_or(t IN ('ARRAY', 'OBJECT')) AS o FROM c GROUP BY key)
  SELECT key, CASE WHEN b THEN 'boolean' WHEN f THEN 'double' WHEN i THEN 'long' ELSE 'string' END AS type, CASE WHEN o OR b::INT + (i OR f)::INT + s::INT > 1 THEN 'values of several kinds or of none' END AS problem FROM f""")
def typed_columns(spark, d):
    """The columns of rows of JSON objects, one of which is declared numeric, and what is wrong with them."""
    return T.inferred(_rows(spark, d), ["rank"])


def _two_revisions(orders, path):
    spark = orders.sparkSession
    rows = orders.select("o_orderkey", F.expr(_SPARK_JSON).alias("json")).withColumn("json", F.regexp_replace("json", r', "(odd|list)": [^,}]+', ""))
    T.write_json(rows, path, ["o_orderkey"], ["rank"])
    T.write(spark.read.parquet(f"{path}/data/1").filter("open"), path, ["_place_o_orderkey"])
    return path


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN round(o_totalprice)::BIGINT::DOUBLE ELSE o_totalprice::DECIMAL(18, 2)::DOUBLE END AS total_price, substr(o_orderpriority, 1, 1)::DOUBLE + 0.5 AS rank, o_orderstatus = 'O' AS open FROM orders),
  a AS (SELECT 1::BIGINT AS revision, row_number() OVER (ORDER BY id) - 1 AS row, * FROM o), b AS (SELECT 2::BIGINT, row_number() OVER (ORDER BY id) - 1 AS row, * FROM o WHERE open), c AS (FROM a UNION ALL FROM b)
  SELECT *, count(*) OVER (PARTITION BY revision) AS total FROM c QUALIFY row BETWEEN 500 AND 699""")
def pinned_pages(spark, d):
    """The same page of a table before and after its next revision was written: the older one is read as it was."""
    root = kept(spark, d, "orders", _two_revisions)
    columns = [F.col("_row").alias("row"), "id", F.col("total").alias("total_price"), "rank", "open", F.col("_total").alias("total")]
    read = lambda n: T.page(spark, root, 500, 200, revision=n).select(F.lit(n).cast("long").alias("revision"), *columns)
    return read(1).union(read(2))


#: Customers as nested documents: objects in objects and in arrays, scalars in arrays, nulls.
_NESTED = """'{"id": ' || c_custkey || ', "type": "customer", "name": "' || c_name || '", "tags": ["' || c_mktsegment || '", ' || c_nationkey || '], "at": {"nation": {"id": ' || c_nationkey || ', "note": null}, "marks": [{"x": 1, "y": [true]}, {"x": ' || (c_custkey % 7) || '}]}}'"""


@query(f"""WITH t AS (SELECT c_custkey, x.* FROM (SELECT c_custkey, ({_NESTED})::JSON AS j FROM customer) c, json_tree(c.j) x),
  o AS (SELECT c_custkey, fullkey AS path FROM t WHERE type = 'OBJECT'), p AS (SELECT *, (SELECT max(path) FROM (SELECT unnest(list_filter(['$', '$.at', '$.at.nation', '$.at.marks[0]', '$.at.marks[1]'], lambda k: k <> t.fullkey AND (starts_with(t.fullkey, k || '.') OR starts_with(t.fullkey, k || '[')))) AS path)) AS owner FROM t)
  SELECT c_custkey AS doc_id, 'element' AS what, owner, fullkey AS path, CASE fullkey WHEN '$' THEN c_custkey::VARCHAR WHEN '$.at.nation' THEN json_extract_string(value, '$.id') END AS value FROM p WHERE type = 'OBJECT'
  UNION ALL SELECT c_custkey, 'property', owner, substr(fullkey, length(owner) + 2), CASE WHEN type <> 'NULL' THEN json_extract_string(value, '$') END FROM p WHERE type NOT IN ('OBJECT', 'ARRAY')""")
def walked_documents(spark, d):
    """Elements with their ids and properties of nested documents, each under the object around it."""
    found = D.walk(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_NESTED).alias("json")))
    elements = found.elements.select("doc_id", F.lit("element").alias("what"), "owner", "path", F.col("id").alias("value"))
    return elements.union(found.properties.select("doc_id", F.lit("property"), "owner", "key", "value"))

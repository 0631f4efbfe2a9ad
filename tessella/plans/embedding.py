"""Queries over chunks for embedding, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import embedding as E, reading as R
from tessella.plans.base import query, table
from tessella.plans.context import _markdown

_BUDGET, _ROWS = E.Budget(96, 16), E.Budget(128)


@query()
def embedding_nodes(spark, d):
    """Nodes of 96 tokens of pages as Markdown, each embedded after its page's host."""
    units = R.units_for_index(R.reading_units(_markdown(spark, d), 12000))
    hosts = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("Host: "), F.coalesce(F.substring(F.regexp_extract("url", r"://([^/?#]*)", 1), 1, 60), F.lit("")), F.lit("\n")).alias("host"))
    return E.finalized(E.embedding_chunks(units.join(hosts, "doc_id"), _BUDGET, F.col("host")), _BUDGET)


_HEADER = "| line |\n|---|\n"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, '# ' || coalesce(source, 'none') || chr(10) || chr(10) || '{_HEADER}' AS caption, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
  r AS (SELECT doc_id, caption, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM d), w AS (SELECT doc_id, n, caption, '| ' || replace(left(line, 60), '|', '/') || ' |' AS row FROM r),
  c AS (SELECT *, len(regexp_extract_all(row, '{E.TOKEN}')) AS cost, {_ROWS.size} - 2 - len(regexp_extract_all(caption, '{E.TOKEN}')) AS room FROM w),
  g AS (SELECT doc_id, n, cost AS used, 0 AS ord FROM c WHERE n = 1 UNION ALL SELECT c.doc_id, c.n, CASE WHEN used + cost <= room THEN used + cost ELSE cost END, ord + CASE WHEN used + cost <= room THEN 0 ELSE 1 END FROM g JOIN c ON c.doc_id = g.doc_id AND c.n = g.n + 1),
  t AS (SELECT doc_id, ord, any_value(caption) || string_agg(row, chr(10) ORDER BY n) AS text, max(used) + any_value({_ROWS.size} - room) AS length FROM g JOIN c USING (doc_id, n) GROUP BY doc_id, ord)
  SELECT doc_id || ':budget:' || substr(sha1(doc_id || chr(10) || ord || chr(10) || text), 1, 16) AS node_id, doc_id, ord, length::INTEGER AS length, sha1(text) AS content_hash, sha1('File rows' || chr(10) || text) AS embedding_hash, false AS source_read_required FROM t""")
def table_embedding_chunks(spark, d):
    """Documents' lines as rows of a table: chunks of whole rows, each under the caption and header."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit("| "), F.translate(F.substring(line, 1, 60), "|", "/"), F.lit(" |\n")))
    text = F.concat(F.lit("# "), F.coalesce("source", F.lit("none")), F.lit("\n" + _HEADER), F.array_join(rows, ""))
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.alias("text"))
    chunks = E.embedding_chunks(R.units_for_index(R.reading_units(docs, 1 << 30)), _ROWS, F.lit("File rows\n"))
    return E.finalized(chunks, _ROWS).select("node_id", "doc_id", "ord", "length", "content_hash", "embedding_hash", "source_read_required")

"""The operators' queries over the given tables, with their SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, exact_dedup, fim, importance, language, mixing, packing, quality, simhash, token_store, topk, url_templates, warc
from tessella.llm.common import read, shared_dir


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(read(spark, sf_dir, "documents"), shared_dir(spark), end_id=0)
    return token_store.audit(spark, path)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(read(spark, sf_dir, "embeddings"), 1024)
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10)


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(read(spark, sf_dir, "pages"))


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive the pages twice, read both archives back and audit the first against the second, in which records whose url's
    SHA-256 starts with 00 are damaged (every e of their page is an f). Files' names and places are left out."""
    pages = read(spark, sf_dir, "pages")
    html = F.when(F.sha2("url", 256).startswith("00"), F.translate("html", "e", "f")).otherwise(F.col("html"))
    replicas = [warc.read(spark, warc.write(p, shared_dir(spark))).drop("uri", "body") for p in (pages, pages.withColumn("html", html))]
    return warc.audit(*replicas).drop("file", "file_offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"), words=4)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), end_id=1)


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under limits on tokens, turns and loss-bearing tokens, which are those of assistant turns."""
    turns = packing.counted_turns(read(spark, sf_dir, "conversations"))
    return packing.pack_examples(turns, packing.Limits(2048, 16, 1024), cut=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="largest")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), repetition=MOST_EPOCHS)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("words", "items")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(read(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fim.restored(F.col("output"), F.col("form")), 256)}
    return found.withColumns(digests).drop("output")


#: Epochs of any source at most, in the mixing query and the pipeline.
MOST_EPOCHS = 1.5

QUERIES = {f.__name__: f for f in (
    packed_conversations, op1_token_store, op2_topk, op3_url_templates, op4_warc_audit, op5_quality, op6_simhash, op7_language, op8_packing, op9_exact_dedup, op10_mixing,
    op11_importance, op12_decontamination, op13_fill_in_middle,
)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op4_warc_audit": r"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, starts_with(sha256(url), '00') AND contains(html, 'e') AS damaged FROM pages),
             r AS (SELECT page_id, page_id // 512 AS segment, damaged, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
                          || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
                          || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html AS record FROM p),
             m AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY page_id) - 1 AS ordinal, octet_length(encode(record)) AS record_length, sha256(record) AS record_sha256 FROM r),
             l AS (SELECT *, coalesce(sum(record_length + 4) OVER (PARTITION BY segment ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset FROM m),
             n1 AS (SELECT segment, ordinal // 8 AS node, sha256(string_agg(sha256(record_sha256 || ':' || record_offset || ':' || record_length), '' ORDER BY ordinal)) AS h FROM l GROUP BY ALL),
             n2 AS (SELECT segment, node // 8 AS node, sha256(string_agg(h, '' ORDER BY node)) AS h FROM (SELECT segment, node, h FROM n1) GROUP BY segment, node // 8),
             n3 AS (SELECT segment, sha256(string_agg(h, '' ORDER BY node)) AS segment_root FROM n2 GROUP BY segment)
        SELECT segment, ordinal, page_id, record_offset, record_length, record_sha256, CASE WHEN damaged THEN 'corrupt' ELSE 'intact' END AS status, segment_root
        FROM l JOIN n3 USING (segment)""",
    "op10_mixing": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+', 0))::BIGINT AS tokens FROM documents),
             s AS (SELECT source, sum(tokens)::BIGINT AS n, ceil(count(*) / 1024)::BIGINT AS blocks FROM d GROUP BY source),
             a AS (SELECT greatest(0, 1 - ln(1.5) / nullif(ln(max(n) / min(n)), 0)) AS alpha, max(n) AS largest FROM s WHERE n > 0),
             w AS (SELECT source, n, blocks, CASE WHEN n > 0 THEN pow(n / largest, coalesce(alpha, 0)) ELSE 0 END AS raw, CASE WHEN n > 0 THEN round(pow(largest / n, 1 - coalesce(alpha, 0)), 9) ELSE 1 END AS epochs FROM s, a),
             p AS (SELECT source, blocks, epochs, raw / sum(raw) OVER () AS weight FROM w),
             e AS (SELECT doc_id, source, tokens, weight, epochs, ('0x' || substr(sha256('mix-1:' || doc_id), 1, 12))::BIGINT % blocks AS block, unnest(range(ceil(epochs)::BIGINT))::INTEGER AS epoch
                   FROM d JOIN p USING (source)),
             k AS (SELECT *, (row_number() OVER o)::INTEGER AS position, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                          sum(tokens) OVER (PARTITION BY source, block, epoch) AS all_tokens, least(1.0, epochs - epoch) AS share
                   FROM e WINDOW o AS (PARTITION BY source, block, epoch ORDER BY sha256('mix-1:' || doc_id || ':' || epoch), doc_id))
        SELECT doc_id, source, epoch, block, position, tokens, round(weight, 9) AS weight FROM k WHERE share >= 1.0 OR before + tokens / 2 <= share * all_tokens""",
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_NORM} AS norm FROM documents)""",
    "op11_importance": rf"""
        WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
             d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
             u AS (SELECT row, unnest(w) AS word FROM d),
             b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
             k AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INTEGER, 2))::BIGINT)),
                                                lambda c, x: xor(c // 256, t.t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket
                   FROM (SELECT word FROM u UNION SELECT word FROM b), t),
             s AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (word) GROUP BY bucket), g AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
             n AS (SELECT (SELECT count(*) FROM u)::DOUBLE AS s_all, (SELECT count(*) FROM b)::DOUBLE AS t_all),
             a AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN g USING (bucket), n),
             w AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight FROM u JOIN k USING (word) JOIN a USING (bucket) GROUP BY row),
             x AS (SELECT d.row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (row)),
             y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
             r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (row)""",
    "op12_decontamination": rf"""
        WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
             g AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(len(w) - 9), lambda i: w[i + 1 : i + 10]) END) AS gram FROM b WHERE len(w) > 0),
             d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
             m AS (SELECT DISTINCT len(gram) AS m FROM g),
             p AS (SELECT row, i, m, w[i + 1 : i + m] AS gram FROM (SELECT row, w, m, unnest(range(len(w) - m + 1)) AS i FROM d, m WHERE len(w) >= m)),
             h AS (SELECT row, i, m, item_id FROM p JOIN g USING (gram)),
             c AS (SELECT row, count(DISTINCT x) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS x FROM h) GROUP BY row),
             o AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN c USING (row) LEFT JOIN o USING (row)""",
    "op13_fill_in_middle": r"""
        WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             d AS (SELECT doc_id, text, w, len(w)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i::INTEGER, 8))::BIGINT) AS h FROM h),
             c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
             t AS (SELECT *, array_to_string(w[1 : a], '') AS prefix, array_to_string(w[a + 1 : b], '') AS middle, array_to_string(w[b + 1 : n], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM t""",
}

"""Operators against brute force, round trips and held-out accuracy, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from test_near_copies import kept_by_hand
from tessella.llm import exact_dedup, language, mixing, packing, quality, queries, simhash, token_store, tokens, topk, url_templates, warc
from tessella.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _norm string, score string"
FOLDER = "/root/testdata/sf0.001"


def body(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(words))


def odd_documents():
    texts = [None, "", " ", "\n\t", "A b C", "a B c", "don't  stop\n\nnow ", "x <|endoftext|> y", "Ünïcode É é", "日本 語", "a\x00b", body(1, 30), body(1, 30), body(2, 20000)]
    texts += [body(3, 60), body(3, 60).replace("a", "b", 1), body(4, 4), body(4, 3), "same"] + ["same"] * 150
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None, "x", "y", "z") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_exact_groups(docs, none):
    groups = {}
    for r in odd_documents():
        groups.setdefault(lower(r[1]), []).append(r[0])
    for keep, pick in (("largest", max), ("smallest", min)):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, keep=keep).collect()}
        assert got == {i: (pick(g), len(g), i == pick(g)) for g in groups.values() for i in g}
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns
    assert exact_dedup.exact_groups(none).count() == 0
    twice = exact_dedup.exact_groups(docs.limit(0).unionByName(docs.filter("doc_id = 4")).unionByName(docs.filter("doc_id = 4")))
    assert sorted(r["kept"] for r in twice.collect()) == [False, True]


def test_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "A"), (None, None)], "doc_id long, text string")
    kept = [(r["doc_id"], r["text_sha256"][:4]) for r in exact_dedup.exact_groups(rows).filter("kept").collect()]
    assert len(kept) == 2 and any(k[0] == 3 for k in kept)
    assert simhash.near_groups(rows).count() == 4
    assert packing.pack_documents(rows).count() >= 4


def test_encoder_equals_tokenizer():
    import pyarrow as pa

    tk = tokenizer()
    texts = [r[1] or "" for r in odd_documents()] + ["a  b", "a \nb", " lead", "tail ", "it's we'LL", "x²½", "Привет мир", "a 😀 b", "“q” – x…"]
    found = list(tokens.encoded(pa.array(range(len(texts))), pa.array(texts), tokens.default_path()))
    got = [flat[at[k] : at[k + 1]].tolist() for _, flat, at in found for k in range(len(at) - 1)]
    assert got == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_store_round_trip(spark, docs, none):
    tk, start = tokenizer(), 0
    path = token_store.write(docs, shared_dir(spark))
    audit = {r["doc_id"]: r for r in token_store.audit(spark, path).collect()}
    back = {r["doc_id"]: r["ids"] for r in token_store.documents(spark, path).collect()}
    for doc, text, *_ in odd_documents():
        ids = tk.encode(text or "", add_special_tokens=False).ids + [0]
        assert back[doc] == ids
        r = audit[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        start += len(ids)
    assert spark.read.parquet(f"{path}/rows").filter("kind = 'pack'").groupBy("digest").count().filter("count > 1").count() == 0
    assert token_store.audit(spark, token_store.write(none, shared_dir(spark))).count() == 0


def test_packing(spark, docs, none):
    tk, pieces = tokenizer(), {}
    rows = packing.pack_documents(docs).collect()
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc, text, *_ in odd_documents():
        ids, at = np.array(tk.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none).count() == 0


def test_packing_examples_keep_all_limits(spark):
    r = random.Random(5)
    rows = [(i, n := r.randint(1, 900), r.randint(0, n)) for i in range(400)] + [(400, None, None), (401, 0, 0)]
    limits = packing.Limits(1000, 5, 600)
    rows = [(i, n, None if s is None else min(s, 600)) for i, n, s in rows]
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long").coalesce(1), limits).collect()
    assert sorted(x["example_id"] for x in got) == list(range(400))
    bins = {}
    for x in got:
        bins.setdefault(x["sequence_id"], []).append(x)
    sizes = {i: (n, s) for i, n, s in rows}
    for members in bins.values():
        assert sum(x["length"] for x in members) <= 1000 and len(members) <= 5
        assert sum(sizes[x["example_id"]][1] for x in members) <= 600
    with pytest.raises(ValueError):
        packing.Packer(limits, cut=False).add(0, 1001, 0)


def simhash_by_hand(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_by_hand(fps):
    root = {i: i for i in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in fps.items():
        for j, b in fps.items():
            if i < j and (a ^ b).bit_count() <= 4:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in fps}


def test_simhash_documents(docs, none):
    fps = {r[0]: simhash_by_hand(r[1]) for r in odd_documents()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect()}
    roots = components_by_hand(fps)
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in fps.items()}
    assert simhash.near_groups(none).count() == 0


def test_simhash_links_of_dense_buckets(spark, monkeypatch):
    """Chains and a ball of fingerprints, in buckets that are cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(150)}
    centre = r.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    for _ in range(60):
        centre ^= sum(1 << b for b in r.sample(range(64), 4))
        values.add(centre)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    by_hand = components_by_hand({s: v for v, s in signed.items()})
    assert {s: got.get(s, s) for s in by_hand} == by_hand


def test_topk(spark):
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(size=20).astype(np.float32).tolist()) for i in range(600)] + [(600, None), (601, [None] * 20), (602, [float("nan")] * 20), (603, [0.5, 1.0]), (604, [])]
    vectors += [(700 + i, vectors[5][1]) for i in range(30)] + [(5, vectors[5][1])]
    frame = topk.quantized(spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4))
    got = {}
    for x in topk.top_k(frame.filter("vec_id % 100 = 0 or vec_id = 5 or vec_id = 603"), frame, 10, at_once=3).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    data = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v in vectors if v and None not in v and np.isfinite(v).all() and len(v) == 20]
    for q, v in data:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in data if i != q)[:10]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert 603 not in got
    assert topk.top_k(frame.limit(0), frame).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "https://x.example.org/en/12", "https://x.example.org/en/2", "http://a.com/fr/1", "http://a.com/de/1", "http://a.com/de", "http://a.com/en/7", "http://b.net/q?u=http://c.org/"]
    urls += [f"http://hot.com/de/{i}" for i in range(90)] + [f"http://hot.com/en/p{i}.html" for i in range(90)] + ["http://hot.com/" + "x/" * 40]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string").repartition(3)
    got = {r["page_id"]: r for r in url_templates.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        fits = [(h + p, v) for h, p, v in url_templates.RULES if (lower(host) == h or lower(host).endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (lower(host), path, rule)
        assert r["verdict"] == verdict or (verdict is None and r["verdict"] in ("allow", "block"))
    assert len({got[i]["template"] for i in range(12, 102)}) == 1
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i}", None if i == 4 else "" if i == 5 else "é\r\n\r\nWARC/1.0\r\n" * i) for i in range(1200)], "page_id long, url string, html string").repartition(3)
    path = warc.write(pages, shared_dir(spark))
    read = warc.read(spark, path, bodies=True)
    assert {r["page_id"]: r["body"] for r in read.select("page_id", "body").collect()} == {r["page_id"]: r["html"] or "" for r in pages.collect()}
    ours = read.select("page_id", "length", "sha256").cache()
    assert warc.audit(ours, ours).filter("status <> 'intact'").count() == 0
    from pyspark.sql import functions as F

    theirs = ours.filter("page_id <> 700").withColumn("sha256", F.when(F.col("page_id").isin(7, 1100), F.lit("0")).otherwise(F.col("sha256")))
    found = {r["page_id"]: r["status"] for r in warc.audit(ours, theirs).collect()}
    assert {k: v for k, v in found.items() if v != "intact"} == {7: "corrupt", 1100: "corrupt", 700: "surplus"} and len(found) == 1200
    assert {r["page_id"] for r in warc.audit(theirs, ours).filter("status = 'missing'").collect()} == {700}
    assert warc.audit(ours.limit(0), ours.limit(0)).count() == 0
    assert [f.get("warc-record-id") for _, _, f, _ in warc.parsed(b"WARC/1.0\r\nWARC-Record-ID: a\r\nContent-Length: 2\r\n\r\nxx\r\n\r\nbroken")] == ["a", None]


def test_language(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in got)
    odd = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in range(4)) and odd[4]["lang_pred"] == "en"
    assert language.identify(none).count() == 0
    net = language.BiGRU(2, seed=1)
    assert len(language.position_labels(net, ["a", "b"], "é" * 100)) == 200


def test_gradients_by_differences():
    net = language.BiGRU(3, hidden=3, seed=2)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    r = np.random.default_rng(0)
    x, y, w = r.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((6, 4))
    _, grads = net.gradients(x, y, w)
    for name in ("out", "bias", "recur0", "recur1"):
        at = (1, 0)
        net.params[name][at] += 1e-3
        up = net.gradients(x, y, w)[0]
        net.params[name][at] -= 2e-3
        down = net.gradients(x, y, w)[0]
        net.params[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3


def test_quality(spark, docs, none):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    few = labels.filter("doc_id < 100")
    assert quality.classify(docs, few).count() == docs.count()
    assert quality.classify(docs, few.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.classify(none, few).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(docs, repetition=2.0).collect()
    assert {r["doc_id"] for r in got if r["epoch"] == 0} == {r[0] for r in odd_documents()}
    assert max(r["epoch"] for r in got) <= 1
    sizes = [(1000, 1), (100, 2), (10, 5)]
    a = mixing.exponent(sizes, repetition=4)
    assert abs((1000 / 10) ** (1 - a) - 4) < 1e-9
    a = mixing.exponent(sizes, entropy=1.8)
    w = np.array([1000] + [100] * 2 + [10] * 5, float) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.8) < 1e-6
    half = mixing.mix(docs, entropy=0.5, budget=5000).agg({"tokens": "sum"}).first()[0]
    assert half is not None
    assert mixing.mix(none, repetition=2.0).count() == 0
    assert mixing.mixed_documents(docs, repetition=2.0).columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    key = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
    assert key(ours) == key(theirs)


def test_pipeline_stages(spark, docs, none):
    """Each stage on its own input: columns stay, decisions take effect."""
    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = table.limit(3).selectExpr("doc_id + 1000000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    kept = stages["language id"](spark, table.unionByName(extra), FOLDER)
    assert kept.columns == table.columns and kept.filter("doc_id >= 1000000").count() == 0 and kept.count() >= 0.97 * table.count()
    unique = stages["exact dedup"](spark, table, FOLDER)
    assert unique.count() == len({lower(r["text"]) for r in table.collect()})
    fps = {r["doc_id"]: simhash_by_hand(r["text"]) for r in unique.collect()}
    # op6's contract: four words and four bits; the stage: five words and a similarity of 0.8
    assert {r["component_id"] for r in simhash.near_groups(unique).collect()} == set(components_by_hand(fps).values())
    near = stages["simhash near-dedup"](spark, unique, FOLDER)
    assert {r["doc_id"] for r in near.collect()} == kept_by_hand({r["doc_id"]: r["text"] for r in unique.collect()})
    mixed = stages["mixing"](spark, near, FOLDER)
    assert mixed.columns == table.columns and mixed.select("doc_id").distinct().count() == near.count()
    assert stages["packing"](spark, mixed, FOLDER).count() > 0
    assert corpus_pipeline.run(spark, FOLDER).count() > 0

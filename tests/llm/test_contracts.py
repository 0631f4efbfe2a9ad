"""Repeated and null ids, damaged archives, plain twins of trees, and the whole pipeline on odd tables."""

import gzip
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import exact_dedup, language, mixing, near_copies, packing, quality, queries, token_store, tokens, topk, url_templates, warc
from tessella.llm.common import shared_dir

ODD = "doc_id long, text string, lang string, source string, n_chars long, _row_key string, _row_times string, _row_time string, _read_id string, _times string, _time string, keep_id string, _norm string, score string, segment string"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def text_of(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(words))


def odd_rows():
    texts = [(1, text_of(1, 40)), (1, text_of(1, 40)), (1, text_of(2, 40)), (None, text_of(3, 40)), (None, text_of(3, 40)), (None, text_of(4, 40)), (2, None), (3, ""), (4, " \n"), (5, "12 34"), (6, text_of(6, 30000)), (7, text_of(1, 40))]
    return [(i, t, "en" if k % 2 else None, None if k % 3 else "s", None, *(f"{k}x" for _ in range(10))) for k, (i, t) in enumerate(texts)]


def test_cut_equals_the_tokenizers_pattern():
    import pyarrow as pa

    r = random.Random(1)
    parts = ["a", "b", "s", "t", "re", "ve", "ll", "d", "m", "'", "''", " ", "  ", "\n", "\t", "\r", "1", "23", ".", "!?", "é", "ß", "Ж", "½", "«", "\u0301", "…", "€", "日", "\u2003", "\x00", "<|endoftext|>", "don't", "I'll", "\xa0", "😀", "x" * 40]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["".join(r.choice(parts[:28]) for _ in range(r.randint(0, 14))) for _ in range(8000)]
    got = []
    for _, flat, at in tokens.encoded(pa.array(range(len(texts))), pa.array(texts), tokens.default_path()):
        got += [flat[at[k] : at[k + 1]].tolist() for k in range(len(at) - 1)]
    assert got == [e.ids for e in tokenizer().encode_batch_fast(texts, add_special_tokens=False)]


def test_store_keeps_rows_of_one_id_apart(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    for wide in (False, True):
        path = token_store.write(docs, shared_dir(spark), wide=wide)
        tk = tokenizer()
        want = Counter((r[0], tuple(tk.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in token_store.documents(spark, path, wide).collect()) == want
        audit = token_store.audit(spark, path, wide).collect()
        assert all(r["verified"] for r in audit)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in audit) == Counter((i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in want.elements())
        at = 0
        for r in sorted(audit, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in sorted(audit, key=lambda r: r["start"])]
        assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("table", ["pack", "manifest"])
def test_audit_finds_changed_chunks_and_manifests(spark, table):
    import os
    import shutil

    store = token_store.write(spark.createDataFrame([(i, text_of(i, 900)) for i in range(8)], "doc_id long, text string"), shared_dir(spark))
    folder = "rows/kind=pack" if table == "pack" else "manifest"
    path = shared_dir(spark)
    shutil.copytree(store, path, ignore=lambda at, names: [os.path.basename(folder)] if os.path.basename(folder) in names else [])
    rows = spark.read.parquet(f"{store}/{folder}")
    if table == "pack":
        first = rows.agg(F.min("digest")).first()[0]
        rows.withColumn("ids", F.when(F.col("digest") == first, F.concat(F.unhex(F.lit("FFFF")), F.expr("substring(ids, 3)"))).otherwise(F.col("ids"))).write.parquet(f"{path}/{folder}")
    else:
        rows.withColumn("root", F.lit("0")).write.parquet(f"{path}/{folder}")
    bad = [r["doc_id"] for r in token_store.audit(spark, path).collect() if not r["verified"]]
    assert len(bad) == 1 if table == "pack" else len(bad) == 8


def test_topk_of_repeated_queries(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-50, 50, 12).tolist(), "x", "y") for i in range(300)]
    rows += [(100, rows[100][1], "x", "y"), (100, rows[7][1], "x", "y"), (40, rows[41][1], "x", "y"), (40, rows[41][1], "x", "y")]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>, score string, rank string").repartition(3)
    for at_once in (1, 2, 2048):
        got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(frame.filter("vec_id % 100 = 0"), frame, 10, at_once=at_once).collect())
        want = Counter()
        for q, v in {(i, tuple(v)) for i, v, *_ in rows if i % 100 == 0}:
            best = sorted((-int(np.dot(v, w)), i) for i, w, *_ in rows if i != q)[:10]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
        assert got == want


def templates_by_hand(rows, tree):
    """(host, shape) to (template, block rate), by a plain walk; rows: (host, shape, verdict or None)."""
    count = defaultdict(lambda: [0, 0, 0])
    for host, shape, verdict in rows:
        c = count[host, shape]
        c[0] += 1
        c[1] += verdict is not None
        c[2] += verdict == "block"
    at = {key: "" for key in count}
    for level in range(tree.depth + 1):
        children = defaultdict(lambda: [0, 0, 0])
        for (host, shape), path in at.items():
            if len(shape) > level:
                for k in range(3):
                    children[host, path, shape[level]][k] += count[host, shape][k]
        kin = defaultdict(list)
        for (host, path, segment), c in children.items():
            kin[host, path].append((segment, c))
        names = {}
        for (host, path), members in kin.items():
            n, labelled, blocked = (sum(c[k] for _, c in members) for k in range(3))
            known = sum(c[1] > 0 for _, c in members)
            for segment, c in members:
                variable = len(members) > tree.fan and c[0] < tree.share * n / len(members) + 1
                rate = blocked / labelled if labelled else None
                similar = known > 1 and c[1] > 0 and abs(c[2] / c[1] - rate) <= tree.z * (rate * (1 - rate) / c[1]) ** 0.5
                names[host, path, segment] = "*" if variable or similar else segment
        at = {(host, shape): f"{path}/{names[host, path, shape[level]]}" if len(shape) > level else path for (host, shape), path in at.items()}
    by_template, by_host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (host, shape), path in at.items():
        for table, key in ((by_template, (host, path)), (by_host, host)):
            table[key][0] += count[host, shape][1]
            table[key][1] += count[host, shape][2]
    corpus = (sum(c[2] for c in count.values()) + 1) / (sum(c[1] for c in count.values()) + 2)
    out = {}
    for (host, shape), path in at.items():
        host_rate = (by_host[host][1] + tree.prior * corpus) / (by_host[host][0] + tree.prior)
        out[host, shape] = path, (by_template[host, path][1] + tree.prior * host_rate) / (by_template[host, path][0] + tree.prior)
    return out


def test_template_tree_equals_a_plain_walk(spark):
    r = random.Random(4)
    urls = []
    for k in range(3000):
        host = r.choice(["hot.com", "hot.com", "a.org", "example.org", "net.net", "x.b.com"])
        path = "/".join([r.choice(["fr", "de", "en", "es"]), *(r.choice(["news", "shop", "tag", f"w{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}", str(r.randint(1, 99))]) for _ in range(r.randint(0, 4)))])
        urls.append(f"http://{host}/{path}" if k % 50 else r.choice([None, "", "no", f"http://{host}"]))
    urls += urls[:40]
    pages = spark.createDataFrame([(i, u, "c", "c", 1) for i, u in enumerate(urls)], "page_id long, url string, template string, shape string, _fan int").repartition(3)
    tree = url_templates.Tree()
    rows = [(r["page_id"], r["host"], tuple(r["shape"]), r["rule_verdict"]) for r in url_templates.ruled(pages).withColumn("shape", url_templates.shape(F.col("path"), tree.depth)).collect()]
    want = templates_by_hand([r[1:] for r in rows], tree)
    got = {r["page_id"]: r for r in url_templates.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, host, shape, verdict in rows:
        template, rate = want[host, shape]
        assert got[i]["template"] == template and abs(got[i]["impurity"] - rate) < 1e-9
        assert got[i]["verdict"] == (verdict or ("block" if rate > tree.reject else "allow"))


def archive(spark, rows, **options):
    return warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, segment string, node long").coalesce(1), shared_dir(spark), **options)


def test_damaged_archives(spark):
    import glob

    rows = [(i, f"http://h/{i}", f"<p>{text_of(i, 20 + 3000 * (i == 9))}</p>", "x", 1) for i in range(40)] + [(5, "http://h/again", "twice", "x", 1), (None, "u", "h", "x", 1), (41, None, None, "x", 1), (42, "", "", "x", 1)]
    sound, plain = archive(spark, rows, most=16), archive(spark, rows, compression="none")
    ours = warc.read(spark, sound)
    assert ours.count() == 43 and ours.select("file").distinct().count() == 3
    assert warc.audit(ours, warc.read(spark, plain)).filter("status <> 'intact'").count() == 0
    (file,) = (f for f in glob.glob(f"{plain}/*") if not f.endswith("_SUCCESS"))
    data = open(file, "rb").read()
    # the header of 20 is lost, a byte of 30 is changed, 10 and 11 change places, 12 is lost
    at = {int(f["warc-record-id"][10:-1]): (a, n) for a, n, f, _ in warc.parsed(data) if "again" not in f["warc-target-uri"]}
    record = lambda k: data[at[k][0] : at[k][0] + at[k][1] + 4]
    bad = data.replace(record(12), b"").replace(record(20), record(20).replace(b"Content-Length", b"Content-Lengxx")).replace(record(30), record(30).replace(b"<p>", b"<q>"))
    bad = bad.replace(record(10) + record(11), record(11) + record(10))
    if record(10) + record(11) == bad:
        raise AssertionError
    path = shared_dir(spark)
    import os

    os.makedirs(path)
    open(f"{path}/a.warc", "wb").write(bad)
    found = warc.audit(warc.read(spark, path), warc.read(spark, sound)).collect()
    told = {(r["page_id"], r["status"]) for r in found if r["status"] != "intact"}
    assert (30, "corrupt") in told and (20, "missing") in told and (12, "missing") in told and (None, "unreadable") in told
    assert {k for k, s in told if s == "moved"} == {10, 11} and len(told) == 6 and len(found) == 44
    (place,) = ((r["file"], r["file_offset"]) for r in found if r["page_id"] == 30)
    assert place[0].endswith("a.warc") and bad[place[1] :].startswith(record(30)[:60])
    # a damaged gzip file keeps what stands before, and other members can't stop the job
    path = shared_dir(spark)
    os.makedirs(path)
    members = b"".join(gzip.compress(record(k)) for k in range(5))
    open(f"{path}/b.warc.gz", "wb").write(members + gzip.compress(record(6))[:-40] + b"\0" * 20)
    open(f"{path}/c.warc.gz", "wb").write(gzip.compress(record(7)))
    left = warc.read(spark, path).collect()
    assert {0, 1, 2, 3, 4, 7} <= {r["page_id"] for r in left} and None in {r["page_id"] for r in left}


def test_letters_and_windows(spark):
    assert [language.has_letter(t) for t in (None, "", "½ ² 12", "Ⅷ ①", "a", "ª", "ʰ", "日", "_-_")] == [False] * 4 + [True] * 4 + [False]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net, names = language.train(table.filter(~language.held_out()))
    texts = [r["text"] for r in table.orderBy("doc_id").limit(60).collect() if r["text"] and len(r["text"]) < 6000]
    same = []
    for t in texts:  # one pass with the state carried through the whole text
        whole = net.positions(np.frombuffer(t.encode(), np.uint8)[:, None].copy())[:, :, 0]
        same += [names[k] == w for k, w in zip(whole.argmax(1), language.position_labels(net, names, t), strict=True)]
        assert np.abs(whole.mean(0) - language.document_probabilities(net, [t])[0]).max() < 0.03
    assert np.mean(same) > 0.99
    for data in ("é" * 500, "日" * 300, "a", "aé" * 200, "\u0301" * 5):
        rows, own = language.windows(data.encode(), 64, 8)
        assert b"".join(r[a:b].tobytes() for r, (a, b) in zip(rows, own)) == data.encode()
        for r, (a, b) in zip(rows, own):
            r[a:b].tobytes().decode()
    none = table.withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(none.limit(20)).count() == 20
    twice = language.identify(table.limit(30).unionByName(table.limit(30)))
    assert twice.count() == 60


def score_by_hand(forest, row):
    margin = forest.base
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
        node = 0
        for _ in range(forest.depth):
            node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
        margin += value[node - (2**forest.depth - 1)]
    return 1 / (1 + np.exp(-margin))


def test_forest_equals_a_plain_walk(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, len(quality.NAMES))).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    forest = quality.fit(x, y, trees=20)
    assert np.allclose(forest.score(x), [score_by_hand(forest, row) for row in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
    # the first split is the best of all
    stump = quality.fit(x, y, trees=1, depth=1)
    grad, best = y - y.mean(), 0.0
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) >= quality.LEAST_ROWS:
                weight = y.mean() * (1 - y.mean())
                gain = sum(grad[m].sum() ** 2 / (m.sum() * weight + quality.RIDGE) for m in (left, ~left))
                best = max(best, gain)
    left = x[:, stump.feature[0, 0]] <= stump.threshold[0, 0]
    weight = y.mean() * (1 - y.mean())
    assert abs(sum(grad[m].sum() ** 2 / (m.sum() * weight + quality.RIDGE) for m in (left, ~left)) - best) < 1e-6
    docs = spark.createDataFrame([(i, text_of(i, 30)) for i in (1, 1, 3)], "doc_id long, text string")
    assert quality.classify(docs, spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, quality int")).count() == 3


def test_packed_conversations_keep_three_limits(spark):
    folder = "/root/testdata/sf0.001"
    talk, tk = spark.read.parquet(f"{folder}/conversations.parquet").collect(), tokenizer()
    tokens_of, loss_of = Counter(), Counter()
    for r in talk:
        n = len(tk.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        tokens_of[r["conv_id"]] += n
        loss_of[r["conv_id"]] += n * (r["role"] == "assistant")
    rows, bins = queries.packed_conversations(spark, folder).collect(), defaultdict(list)
    placed = Counter()
    for r in rows:
        placed[r["example_id"]] += r["length"]
        bins[r["sequence_id"]].append(r)
    assert placed == tokens_of
    for parts in bins.values():
        assert sum(r["length"] for r in parts) <= 2048 and len(parts) <= 16
        loss = 0
        for r in parts:
            total, last = tokens_of[r["example_id"]], loss_of[r["example_id"]]
            loss += max(0, r["start"] + r["length"] - max(r["start"], total - last))
        assert loss <= 1024


def test_every_stage_and_the_pipeline_on_odd_tables(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        whole = {tuple(r) for r in rows}
        assert all(tuple(r) in whole for r in got.collect()), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    once = exact_dedup.drop_exact_copies(docs).collect()
    assert len(once) == len({(r[1] or "").lower() for r in rows})
    assert near_copies.drop_near_copies(docs).count() == 7  # five texts, the blank ones, the digits
    assert Counter(map(tuple, mixing.mixed_documents(docs, repetition=1.0).collect())) == Counter(rows)
    assert mixing.mixed_documents(docs, entropy=0.5, budget=10).count() <= len(rows)
    for table in (docs, docs.limit(0), docs.unionByName(docs)):
        folder = str(tmp_path / f"t{random.random()}")
        table.write.parquet(f"{folder}/documents.parquet")
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        packed = corpus_pipeline.run(spark, folder).collect()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
        texts = {r["doc_id"] for r in packed}
        assert texts == ({1, None, 6} if table.limit(1).count() else set())


def test_linked_similarity_is_exact():
    r = random.Random(5)
    sets = [np.unique(np.array([r.randrange(40) for _ in range(r.randint(1, 30))], np.uint64)) for _ in range(60)]
    pairs = near_copies.linked(sets, np.arange(60))
    root = list(range(60))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        assert Fraction(len(set(sets[a].tolist()) & set(sets[b].tolist())), len(set(sets[a].tolist()) | set(sets[b].tolist()))) >= Fraction(4, 5)
        root[find(a)] = find(b)
    for a in range(60):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 5 * len(x & y) >= 4 * len(x | y):
                assert find(a) == find(b)


def test_urls_split_like_a_plain_rule(spark):
    urls = [None, "", "a", "x://", "x://H?", "x://a#b/c", "x://A.B/c?d", "HTTP://É.org/É#", "://h/p"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_templates.ruled(rows).collect():
        u = urls[r["page_id"]]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        assert (r["host"], r["path"]) == (re.sub("[A-Z]", lambda m: m[0].lower(), host), path)


def test_packing_of_repeated_rows(spark):
    docs = spark.createDataFrame(odd_rows() * 2, ODD).repartition(2)
    got = packing.pack_documents(docs).collect()
    tk = tokenizer()
    want = Counter()
    for r in odd_rows() * 2:
        want[r[0]] += len(tk.encode(r[1] or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want

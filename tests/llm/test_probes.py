"""Hot groups without ids, large components, clashing names, shared hashes and archives of many members."""

import gzip
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tessella.llm import exact_dedup, mixing, near_copies, simhash, token_store, topk, warc


def test_one_row_of_a_hot_text_without_ids_stays(spark):
    rows = [(None, "same text")] * 300 + [(k, "other") for k in range(300)] + [(7, "repeated")] * 300 + [(None, "one id")] * 200 + [(5, "one id")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for keep, other in (("smallest", 0), ("largest", 299)):
        got = exact_dedup.exact_groups(docs, keep=keep).filter("kept").collect()
        assert Counter(r["doc_id"] for r in got) == Counter([None, other, 7, 5])
        assert all(r["group_size"] == 300 and r["doc_id"] == r["keep_id"] for r in got)
        left = exact_dedup.drop_exact_copies(docs, keep=keep).collect()
        assert Counter(map(tuple, left)) == Counter([(None, "same text"), (other, "other"), (7, "repeated"), (5, "one id")])


def test_rows_without_id_are_dealt_over_blocks(spark):
    docs = spark.createDataFrame([(None, f"a b {k % 9}", "s") for k in range(4000)], "doc_id long, text string, source string").repartition(3)
    sizes = mixing.mix(docs, repetition=1.5).groupBy("block").count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) < 1200
    assert simhash.near_groups(docs).filter("component_id is null").count() == 4000


@pytest.mark.parametrize("size", [40_000, 10**8, 3 * 10**8])
def test_scores_are_exact_beyond_doubles(spark, size):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-size, size, 16).tolist()) for i in range(429)]
    if size < 10**6:  # near the largest sums, neighbours differ by less than a double can tell
        base = [94_906_267] * 16
        rows += [(1000 + i, [x + int(d) for x, d in zip(base, r.integers(0, 2, 16))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = Counter(map(tuple, topk.top_k(frame.filter("vec_id % 100 = 0"), frame, 10).collect()))
    want = Counter()
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:10]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert got == want


def test_scores_and_components_beyond_a_long_are_errors(spark):
    frame = spark.createDataFrame([(i, [10**17 + i] * 4) for i in range(20)], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(frame.filter("vec_id = 0"), frame, 3).collect()
    with pytest.raises(Exception, match="beyond a long"):
        topk.quantized(spark.createDataFrame([(1, [1e17])], "vec_id long, embedding array<double>")).collect()


def test_stages_keep_a_column_named_metadata(spark, tmp_path):
    rows = [(k, f"word{k % 4} text of some length here", "en", "s", 3, f"m{k}", k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _metadata string, _METADATA_ long").repartition(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for table in (docs, spark.read.parquet(str(tmp_path / "documents.parquet"))):
        for name, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, table, "")
            assert got.columns == docs.columns, name
            assert all(r["_metadata"] == f"m{r['doc_id']}" for r in got.collect()), name


def test_narrow_stores_refuse_wide_ids(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="wide=True"):
        token_store.audit(spark, token_store.write(docs, token_store_path(spark), end_id=70_000, wide=False)).collect()


def token_store_path(spark):
    from tessella.llm.common import shared_dir

    return shared_dir(spark)


def test_sets_that_share_a_name_are_told_apart(spark):
    kind = near_copies._NODE
    rows = [((1, k), k, 5, other, 3, 2, [1], b"\0" * 16) for k, other in ((1, 10), (2, 10), (3, 20))] + [((1, 9), 9, 8, 1, 3, 2, [1], b"\0" * 16)]
    sketched, nodes = near_copies._named(near_copies.materialize(spark.createDataFrame(rows, kind)))
    names = {r["doc_id"]: r["sid"] for r in sketched.collect()}
    assert names[1] == names[2] != names[3] and 5 not in names.values() and names[9] == 8
    assert nodes.count() == 3 and {r["row"]["at"] for r in nodes.collect()} == {1, 3, 9}
    batch = pa.RecordBatch.from_arrays([pa.array([{"file": 1, "at": 1}]), pa.array([1]), pa.array(["a b c d e f"])], names=["a", "b", "c"])
    (out,) = near_copies._sketch(iter([batch]))
    found = near_copies.shingles("a b c d e f").tobytes()
    assert [np.uint64(np.int64(out.column(k)[0].as_py())) for k in (2, 3)] == [xxhash.xxh64_intdigest(found), xxhash.xxh64_intdigest(found, 1)]


def test_many_members_are_read_in_proportion():
    body = np.random.default_rng(2).integers(97, 105, 4000, dtype=np.uint8).tobytes()
    member = gzip.compress(b"WARC/1.0\r\nContent-Length: 4000\r\n\r\n" + body + b"\r\n\r\n")
    began = time.process_time()
    data, whole = warc.inflated(member * 10_000)
    assert whole and len(data) == 10_000 * (4000 + 38) and time.process_time() - began < 5
    assert warc.inflated(member + member[:-20])[1] is False
    assert warc.inflated(member + b"\0" * 50) == (warc.inflated(member)[0], False)

"""SimHash near-dedup with pigeonring filtering.

The 64 bits of a fingerprint are five consecutive segments on a ring. If two fingerprints differ in at most `most` bits,
there is a segment from which every chain of l consecutive segments differs in at most l * most / 5 bits (the pigeonring
principle). With most = 4 the budgets are 0, 1, 2, 3, 4: the first segment is equal, and of the next, which may differ
in one bit, one half is equal. Fingerprints therefore meet by (segment, its bits, half of the next one): ten keys each.
Within a bucket the chain budgets prune pairs segment by segment before the whole difference is counted, and a bucket
gives a spanning forest of its links, never all pairs. Buckets over BLOCK fingerprints are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, heavy_counts, heavy_keys, materialize, skew_join

SEED = 42
SEGMENTS = (13, 13, 13, 13, 12)
MOST = 4
BLOCK = 1024
_SHIFTS = tuple(64 - sum(SEGMENTS[: i + 1]) for i in range(5))


def hashes(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles (A-Z lower-cased) in order; a text of fewer words is one, a blank one has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    stops = ends[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))


def majority(found: np.ndarray) -> int:
    """The bits that more than half of the hashes have set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 15):
        counts += np.unpackbits(found[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(found)).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of a text's word shingles (A-Z lower-cased, repeats count); without words 0."""
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every whole text; null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _segment(value, i: int):
    return F.shiftrightunsigned(value, _SHIFTS[i]).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1))


def _keys(fp) -> list:
    out = []
    for i in range(5):
        after, width = _segment(fp, (i + 1) % 5), SEGMENTS[(i + 1) % 5]
        low = width // 2
        for half, bits in enumerate((F.shiftrightunsigned(after, low), after.bitwiseAND(F.lit((1 << low) - 1)))):
            out.append(_segment(fp, i) * (1 << 7) + bits + F.lit((i * 2 + half) << 20))
    return out


def survivors(a: np.ndarray, b: np.ndarray, first: np.ndarray, most: int = MOST) -> np.ndarray:
    """Indexes of the pairs that keep every chain budget from their segment first on, and differ in at most `most` bits."""
    left, differ = np.arange(len(a)), a ^ b
    spent = np.zeros(len(a), np.int64)
    shifts, masks = np.array(_SHIFTS, np.uint64), np.array([(1 << w) - 1 for w in SEGMENTS], np.uint64)
    for chain in range(5):
        at = (first[left] + chain) % 5
        spent = spent + np.bitwise_count(differ[left] >> shifts[at] & masks[at])
        ok = spent <= (chain + 1) * most // 5
        left, spent = left[ok], spent[ok]
    return left


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From buckets (first segment, fingerprints) to links a < b that connect what is linked within each."""
    for batch in batches:
        firsts, lists = np.asarray(batch.column(0)), batch.column(1)
        at = np.asarray(lists.offsets).astype(np.int64)
        flat = np.asarray(lists.flatten()).view(np.uint64)
        out: list[np.ndarray] = []
        sizes = np.diff(at)
        # small buckets side by side: each element with the one `lag` places on
        small = np.flatnonzero((sizes > 1) & (sizes <= 16))
        if len(small):
            where = np.concatenate([np.arange(at[k], at[k + 1]) for k in small])
            own = np.repeat(small, sizes[small])
            seen: dict[tuple[int, int], int] = {}
            for lag in range(1, int(sizes[small].max())):
                i = np.flatnonzero(own[:-lag] == own[lag:])
                a, b = where[i], where[i + lag]
                ok = survivors(flat[a], flat[b], firsts[own[i]])
                for k, x, y in zip(own[i][ok].tolist(), a[ok].tolist(), b[ok].tolist(), strict=True):
                    if _union(seen, (k, x), (k, y)):
                        out.append(flat[[x, y]])
        for k in np.flatnonzero(sizes > 16):
            out += _bucket(flat[at[k] : at[k + 1]], int(firsts[k]))
        pairs = np.sort(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _union(parent: dict, x, y) -> bool:
    def root(v):
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    p, q = root(x), root(y)
    if p != q:
        parent[max(p, q)] = min(p, q)
    return p != q


def _bucket(values: np.ndarray, first: int) -> list[np.ndarray]:
    """Spanning forest of one bucket: each value that is reached looks once at those not reached yet."""
    waiting, out = np.arange(len(values)), []
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            x = queue.pop()
            near = survivors(np.full(len(waiting), values[x]), values[waiting], np.full(len(waiting), first))
            found = waiting[near]
            out += [values[[x, y]] for y in found]
            queue += found.tolist()
            waiting = np.delete(waiting, near)
    return out


def links(distinct: DataFrame) -> DataFrame:
    """Links (a < b) among distinct fingerprints fp that connect all that differ in at most MOST bits, directly or not; an empty table has none."""
    fp = F.col("fp")
    keyed = distinct.select("fp", F.explode(F.array(*_keys(fp))).alias("key"))
    counts = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    hot = heavy_counts(counts, ["key"], distinct.count())
    rows = skew_join(keyed, counts.withColumnRenamed("_n", "n"), "key", hot, F.col("fp")).filter("n is not null")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = rows.select("fp", "key", own.alias("own"), pairs.alias("other"))
    dealt = dealt.select("fp", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    buckets = dealt.groupBy("key", "x", "y").agg(F.collect_list("fp").alias("fps"))
    first = (F.shiftright(F.col("key"), 20) / 2).cast("int").alias("first")
    return buckets.filter(F.size("fps") > 1).select(first, "fps").mapInArrow(_forest, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node that it is connected with) for every node of edges (a, b).

    Each round a node takes the smallest root among its own and its neighbours', roots pass theirs on to their own
    root and every node jumps to its root's root; it ends when nothing changes. Rounds are written to the shared folder.
    """
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a")))
    state = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")))
    for _ in range(most_rounds):
        near = both.join(state.select(F.col("node").alias("to"), F.col("root").alias("r")), "to").groupBy("node").agg(F.min("r").alias("r"))
        best = state.join(near, "node").select("node", "root", F.least("root", "r").alias("r"))
        hooked = best.select("node", "r").union(best.select(F.col("root"), "r")).groupBy("node").agg(F.min("r").alias("r"))
        hooked = materialize(hooked)
        jumped = hooked.join(hooked.select(F.col("node").alias("r"), F.col("r").alias("rr")), "r").select("node", F.least("r", "rr").alias("root"))
        after = materialize(jumped)
        settled = after.join(state, ["node", "root"], "left_anti").isEmpty()
        discard(hooked, state)
        if settled:
            discard(both)
            return after
        state = after
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def near_groups(docs: DataFrame, words: int = 4) -> DataFrame:
    """One row per document (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Documents link when their fingerprints differ in at most MOST bits; texts without words share the fingerprint 0.
    Null texts count as empty; a null doc_id is grouped but is never a component's id unless nothing else is there;
    repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, words))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = materialize(components(materialize(links(distinct.select("fp")))))
    linked = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    table = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    joined = skew_join(rows, table, "fp", heavy_keys(rows, "fp", docs.count()), F.monotonically_increasing_id())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["components", "fingerprint", "fingerprints", "hashes", "links", "majority", "near_groups", "survivors"]

"""Token-id output: a content-addressed store.

Layout below one folder (Parquet, every file readable alone):

* ``rows/kind=pack``   digest, ids: each distinct chunk of token ids once, little-endian unsigned 16- or 32-bit, named by its SHA-256
* ``rows/kind=recipe`` doc_id, row, seq, digest, n: which chunks make up a document (as written by the encoding tasks); row tells documents with one id apart
* ``recipes``          the recipes in ascending doc_id order: doc_id, row, n_tokens, chunks, root (Merkle root over its chunks' digests), part, ordinal (its place in the part) and start (the ids before it in the part)
* ``manifest``         one row per recipe part: the ids before it, and the Merkle root over its documents' leaves, which name doc_id, start, n_tokens and root

A rolling hash over the last WINDOW ids cuts a document's stream where its low bits are zero, so equal passages give
equal chunks wherever they stand. A task writes a chunk once; copies from different tasks meet by digest and one stays.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tessella.llm.common import heavy_keys, skew_join
from tessella.llm.tokens import default_path, encoded

WINDOW = 16
MIN_IDS, MASK_BITS, MAX_IDS = 256, 10, 8192
#: Digests that a task remembers as written; beyond it the oldest half is forgotten and a later copy is dropped by the shuffle.
REMEMBERED = 50_000

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def marks(ids: np.ndarray, bits: int = MASK_BITS) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids has its high bits zero; the window doubles four times."""
    rolling, width = _GEAR[ids & np.uint32(0xFFFF)], 1
    while width < WINDOW:
        grown = rolling.copy()
        grown[width:] += rolling[:-width] << np.uint32(width)
        rolling, width = grown, 2 * width
    return np.flatnonzero(rolling < np.uint32(1 << 32 - bits)) + 1


def cuts(places: list[int], first: int, last: int, minimum: int = MIN_IDS, maximum: int = MAX_IDS) -> list[int]:
    """Ends of the chunks of the stream [first, last): at the marks' places, at least minimum (but for the last) and at
    most maximum ids. A chunk is longer than the window, so what stands before a stream doesn't move its cuts."""
    out, at = [], first
    while last - at > minimum:
        i = bisect.bisect_left(places, at + minimum)
        at = min(places[i] if i < len(places) else last, at + maximum, last)
        out.append(at)
    if at < last:
        out.append(last)
    return out


def _chunked(path: str, end_id: int, wide: bool):
    kind, width = ("<u4", 4) if wide else ("<u2", 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for own, flat, at in encoded(batch.column(0), batch.column(1), path):
                stream = np.insert(flat, at[1:], np.uint32(end_id))
                if not wide and len(stream) and stream.max() > 0xFFFF:
                    raise ValueError(f"id {stream.max()} needs wide=True")
                bounds = (at + np.arange(len(at))).tolist()
                places, data = marks(stream).tolist(), stream.astype(kind).tobytes()
                seqs: list[int] = []
                counts, sizes, digests, packs, named = [], [], [], [], []
                for last, stop in zip(bounds, bounds[1:]):
                    ends = cuts(places, last, stop)
                    counts.append(len(ends))
                    seqs += range(len(ends))
                    for end in ends:
                        blob = data[width * last : width * end]
                        digest = hashlib.sha256(blob).digest()
                        digests.append(digest)
                        sizes.append(end - last)
                        if digest not in seen:
                            seen[digest] = None
                            named.append(digest)
                            packs.append(blob)
                        last = end
                if len(seen) > REMEMBERED:
                    for old in list(seen)[: REMEMBERED // 2]:
                        del seen[old]
                whose = np.repeat(np.arange(len(own)), counts)
                yield _batch("recipe", pa.array(own, pa.int64()).take(pa.array(whose)), pa.array(row + whose), pa.array(seqs, pa.int32()), digests, pa.array(sizes, pa.int32()), None)
                yield _batch("pack", None, None, None, named, pa.array([len(p) // width for p in packs], pa.int32()), packs)
                row += len(own)

    return run


_SCHEMA = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()), ("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary())])
_ROWS = "kind string, doc_id long, row long, seq int, digest binary, n int, ids binary"


def _batch(kind: str, *columns) -> pa.RecordBatch:
    """A batch of one kind of rows; columns that aren't given are null."""
    n = len(columns[3])
    arrays = [pa.nulls(n, f.type) if c is None else pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip((pa.repeat(kind, n), *columns), _SCHEMA, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree over ordered digests; an odd last node moves up as it is."""
    level = digests or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a part's documents in order: adds their place, the ids before them in the part, and the root of their chunks."""
    place, before = 0, 0
    for batch in batches:
        roots = [merkle([c["digest"] for c in chunks]).hex() for chunks in batch.column("chunks").to_pylist()]
        ids = np.asarray(batch.column("n_tokens"))
        ends = before + np.cumsum(ids)
        new = [pa.array(place + np.arange(len(batch))), pa.array(ends - ids), pa.array(roots, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "ordinal", "start", "root"])
        place, before = place + len(batch), int(ends[-1]) if len(batch) else before


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle([n["node"] for n in nodes]) for nodes in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary())], names=["part", "at", "node"])


def part_roots(recipes: DataFrame) -> DataFrame:
    """part and root of the tree over its documents' leaves, by subtrees of 1,024 so that no task holds all leaves of a part."""
    leaf = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", "root"), 256))
    nodes = recipes.select("part", F.col("ordinal").alias("at"), leaf.alias("node"))
    for level in (F.floor(F.col("at") / 1024).cast("long"), F.lit(0).cast("long")):
        lists = nodes.groupBy("part", level.alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("nodes"))
        nodes = lists.mapInArrow(_trees, "part int, at long, node binary")
    return nodes.select("part", F.lower(F.hex("node")).alias("root"))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, wide: bool = False) -> str:
    """Encode whole texts of docs (doc_id, text), append end_id to each and write the store at path; returns path.

    Every row is a document of its own: rows that repeat an id stay apart, one after another, and rows without an id come
    last. A null text counts as empty (its stream is end_id alone); an empty table writes an empty store; other columns are
    ignored. wide: 32-bit ids, for vocabularies over 65,536. docs should be a table that is read alike when a task is
    repeated, as rows are known by their place in it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_chunked(tokenizer or default_path(), end_id, wide), _ROWS)
    # packs meet by digest; recipes are dealt by document, so a chunk that many documents share makes no large partition
    route = F.when(F.col("kind") == "pack", F.xxhash64("digest")).otherwise(F.xxhash64("row", "seq"))
    unique = rows.withColumn("route", route).repartition("route").dropDuplicates(["route", "kind", "digest", "row", "seq"]).drop("route")
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/rows")
    recipe = _rows(spark, path).filter("kind = 'recipe'").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").cast("long").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "digest", "n"))), lambda c: F.struct(c["digest"].alias("digest"), c["n"].alias("n"))).alias("chunks")
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = recipe.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds = "doc_id long, row long, n_tokens long, chunks array<struct<digest: binary, n: int>>, part int, ordinal long, start long, root string"
    parts.select("doc_id", "row", "n_tokens", "chunks", "part").mapInArrow(_placed, kinds).write.parquet(f"{path}/recipes")
    recipes = spark.read.schema(kinds).parquet(f"{path}/recipes")
    totals = recipes.groupBy("part").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"))
    # one row a part: how many ids stand before it
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.withColumn("before", before).join(part_roots(recipes), "part").write.parquet(f"{path}/manifest")
    return path


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, row long, seq int, digest binary, n int, ids binary, kind string").parquet(f"{path}/rows")


def _checked(wide: bool):
    kind, width = ("<u4", 4) if wide else ("<u2", 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crc = [zlib.crc32(np.frombuffer(b, kind, len(b) // width).astype("<u4").tobytes()) for b in blobs]
            found = [hashlib.sha256(b).digest() for b in blobs]
            sound = [f == d and len(b) % width == 0 for f, b, d in zip(found, blobs, digests, strict=True)]
            sizes = [len(b) // width for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(sound)], names=["digest", "crc", "size", "found", "sound"])

    return run


def _powers() -> list[np.ndarray]:
    """Operators on a CRC-32 register for 2**k zero bytes each, as 32 columns of bits (the reflected polynomial EDB88320)."""
    one = np.array([0xEDB88320, *(1 << np.arange(31))], np.uint64)  # one zero bit
    for _ in range(3):
        one = _apply(one, one)
    out = [one]
    for _ in range(40):
        out.append(_apply(out[-1], out[-1]))
    return out


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The operator's product with each value, over two-element arithmetic."""
    out = np.zeros(len(values), np.uint64)
    for bit in range(32):
        out ^= np.where(values >> np.uint64(bit) & np.uint64(1), columns[bit], np.uint64(0))
    return out


_POWERS = _powers()


def crc_append(crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of A + B from those of A and B and B's bytes, elementwise."""
    out, size = crc.astype(np.uint64), size.astype(np.uint64)
    for k in range(int(size.max(initial=0)).bit_length()):
        on = (size >> np.uint64(k) & np.uint64(1)).astype(bool)
        if on.any():
            out[on] = _apply(_POWERS[k], out[on])
    return out ^ tail.astype(np.uint64)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a document's chunks in order, as they were read: the sum of all its ids, their number, and the root of the chunks' tree."""
    for batch in batches:
        lists = batch.column(1)
        at = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.flatten()
        crc, n = np.asarray(flat.field("crc")).astype(np.uint64), np.asarray(flat.field("size")).astype(np.int64)
        found = flat.field("found").to_pylist()
        at = at - at[0] if len(at) else at
        count, base, spans = np.diff(at), at[:-1], list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        roots, read = [merkle(found[a:b]).hex() for a, b in spans], [int(n[a:b].sum()) for a, b in spans]
        out = np.zeros(len(count), np.uint64)
        for k in range(int(count.max(initial=0))):
            live = np.flatnonzero(count > k)
            out[live] = crc_append(out[live], crc[base[live] + k], 4 * n[base[live] + k])
        arrays = [batch.column(0), batch.column(2), pa.array(out.astype(np.int64)), pa.array(read, pa.int64()), pa.array(roots, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "sound", "ids_crc32", "read", "tree"])


def _joined(spark: SparkSession, path: str, packs: DataFrame) -> DataFrame:
    """The recipes' chunks (row, seq, digest, n) with what packs holds of each; a chunk that many documents share is dealt over salts."""
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("row", F.posexplode("chunks").alias("seq", "chunk")).select("row", "seq", F.col("chunk.digest").alias("digest"), F.col("chunk.n").alias("n"))
    return skew_join(uses, packs, "digest", heavy_keys(uses, "digest", recipes.count()), F.struct("row", "seq"))


def audit(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Read a store back: doc_id, start, n_tokens, ids_crc32, verified.

    Every stored chunk is read, checked against its name and summed once; a document's sum follows from its chunks'
    (CRC-32 of a concatenation), so ids aren't shuffled. verified: all chunks are there and sound, their lengths agree with
    the recipe's and with n_tokens, the tree over the chunks read back has the recipe's root, and the tree over its part's
    recipes has the manifest's. A part that disagrees with the manifest has no verified document. A document that was encoded
    but has no recipe gives a row without start and sums, as does (without doc_id) a part of the manifest that has no
    recipes. Null and repeated ids give a row for every document; an empty store gives none.
    """
    packs = _rows(spark, path).filter("kind = 'pack'").select("digest", "ids").mapInArrow(_checked(wide), "digest binary, crc long, size long, found binary, sound boolean")
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    part = F.struct("seq", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.coalesce("found", F.unhex(F.lit(""))).alias("found"))
    sound = F.every(F.coalesce(F.col("sound") & (F.col("size") == F.col("n")), F.lit(False)))
    rebuilt = _joined(spark, path, packs).groupBy("row").agg(F.array_sort(F.collect_list(part)).alias("parts"), sound.alias("sound")).mapInArrow(_rebuilt, "row long, sound boolean, ids_crc32 long, read long, tree string")
    totals = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"))
    # one row a part, and parts are tasks: few
    same = ["part", "documents", "ids", "root"]
    agreed = totals.join(part_roots(recipes), "part").join(manifest.select(*same, "before"), same).select("part", "before", F.lit(True).alias("agreed"))
    checked = recipes.drop("chunks", "ordinal").join(rebuilt, "row", "left").join(F.broadcast(agreed), "part", "left")
    verified = F.coalesce(F.col("sound") & F.col("agreed") & (F.col("read") == F.col("n_tokens")) & (F.col("tree") == F.col("root")), F.lit(False))
    written = _rows(spark, path).filter("kind = 'recipe' and seq = 0").select("row", F.col("doc_id").alias("own"))
    start = F.col("start") + F.coalesce("before", F.lit(0))
    rows = checked.join(written, "row", "full").select(F.coalesce("doc_id", "own").alias("doc_id"), start.alias("start"), "n_tokens", "ids_crc32", verified.alias("verified"))
    none = F.lit(None).cast("long")
    lost = manifest.join(totals.select("part"), "part", "left_anti").select(none.alias("doc_id"), none.alias("start"), none.alias("n_tokens"), none.alias("ids_crc32"), F.lit(False).alias("verified"))
    return rows.union(lost)


def documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id and its ids in order, put together from the chunks; a row for every document, also where ids repeat or are null."""
    width = 4 if wide else 2
    packs = _rows(spark, path).filter("kind = 'pack'").select("digest", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(b"".join(x["ids"] for x in parts), f"<u{width}").astype(np.int64).tolist() for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=["row", "ids"])

    put = _joined(spark, path, packs).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts")).mapInArrow(run, "row long, ids array<long>")
    return spark.read.parquet(f"{path}/recipes").select("doc_id", "row").join(put, "row").select("doc_id", "ids")

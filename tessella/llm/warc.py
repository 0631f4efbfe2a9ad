"""WARC archives and their Merkle fixity audit.

Records are WARC/1.0 resource records; Spark's text writer ends each with the blank lines that the format asks for, so
every task writes one archive file, in which records stand by page_id. Reading parses whole files inside tasks by their
Content-Length, goes on at the next record after a damaged one, and keeps what stands before a damaged place of a gzip file.

A segment is a range of SEGMENT record ids. Its records, in the order in which the archive holds them, are the leaves of a
tree with FAN children a node; a leaf hashes a record's digest and its range (offset and length) in the segment's stream.
An audit compares the roots of two replicas' segments and descends only into children of nodes that differ; the leaves so
found, and only they, are fetched and told apart as corrupt, moved, missing or surplus records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize

FAN, LEVELS = 8, 3
SEGMENT = FAN**LEVELS
#: WARC-Date of pages that come without the time of their capture.
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n\r\n"
#: Bytes of a gzip file that are inflated at a time.
STEP = 1 << 14


def rendered(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A page's record without the blank lines after it; null urls and pages count as empty, line ends in a url are left out."""
    body, uri = F.coalesce(html, F.lit("")), F.coalesce(F.regexp_replace(url, r"[\r\n]", ""), F.lit(""))
    head = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", page_id.cast("string"), f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: ", uri, "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(body).cast("string"), _END]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head), body)


def write(pages: DataFrame, path: str, compression: str = "gzip", most: int = 16384) -> str:
    """Write pages (page_id, url, html) as WARC files of at most `most` records below path, one or more a task; returns path.

    Whole segments go to one task, in order of page_id. Rows without page_id are left out, as a record needs its name;
    rows that repeat a page_id are records of their own; an empty table writes no record; other columns are ignored.
    """
    rows = pages.filter("page_id is not null").select("page_id", "url", "html", F.floor(F.col("page_id") / SEGMENT).alias("segment"))
    ordered = rows.repartitionByRange("segment").sortWithinPartitions("page_id", "url", F.xxhash64("html"))
    ordered.select(rendered(F.col("page_id"), F.col("url"), F.col("html"))).write.option("lineSep", _END).option("compression", compression).option("maxRecordsPerFile", most).text(path)
    return path


def parsed(data: bytes) -> Iterator[tuple[int, int, dict[str, str], int]]:
    """(offset, length, headers, start of the body) of a WARC stream's records; length is without the blank lines.

    Where a header or length is damaged, what stands before the next record's header is given as one record without headers.
    """
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        fields = {}
        if data.startswith(b"WARC/", at) and head > 0:
            for line in data[at:head].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        size = fields.get("content-length", "")
        end = head + 4 + int(size) if size.isdigit() else -1
        # a record ends at the stream's end or before blank lines
        if 0 <= end <= len(data) and (end == len(data) or data.startswith(b"\r\n", end)):
            yield at, end - at, fields, head + 4
            at = end
        else:
            after = data.find(b"\r\n\r\nWARC/1.", at + 1)
            end = after if after >= 0 else len(data)
            yield at, end - at, {}, end
            at = end
        while data[at : at + 2] == b"\r\n":
            at += 2


def inflated(data: bytes) -> tuple[bytes, bool]:
    """The content of a plain or gzip file of any number of members up to its first damaged place, and whether there is none.

    Bytes are inflated in small steps, so that what stands before a damaged place is kept and a member costs no more than its
    own length and a step.
    """
    if data[:2] != b"\x1f\x8b":
        return data, True
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        stream = zlib.decompressobj(31)
        while not stream.eof:
            step = view[at : at + STEP]
            if not step:
                return b"".join(out), False
            try:
                out.append(stream.decompress(step))
            except zlib.error:
                return b"".join(out), False
            at += len(step)
        at -= len(stream.unused_data)
    return b"".join(out), True


def read(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """Records of all WARC files (plain or gzip) below path: page_id, file, offset, length, sha256 of the record, uri and, if bodies, the body.

    What can't be read as a record has no page_id: a stretch whose header or length is damaged, and (length 0) the damaged
    place of a gzip file. A file must fit a worker's memory: write() bounds its records.
    """
    names = ["page_id", "file", "offset", "length", "sha256", "uri", "body"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([],) * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for k in range(len(files)):
                file, rows = files.column(0)[k].as_py(), []
                data, whole = inflated(files.column(1)[k].as_py())
                for at, length, fields, body in parsed(data):
                    key = fields.get("warc-record-id", "").removeprefix("<urn:page:").rstrip(">")
                    text = data[body : at + length].decode("utf-8", "replace") if bodies else None
                    rows.append((int(key) if key.lstrip("-").isdigit() else None, file, at, length, hashlib.sha256(memoryview(data)[at : at + length]).hexdigest(), fields.get("warc-target-uri"), text))
                    if len(rows) == 2048:
                        yield batch(rows)
                        rows = []
                if not whole:
                    rows.append((None, file, len(data), 0, None, None, None))
                yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, "page_id long, file string, offset long, length long, sha256 string, uri string, body string")


def leaves(records: DataFrame) -> DataFrame:
    """segment, node (the place among the segment's leaves), page_id, file, offset (in the file), record_offset (in the
    segment's stream), length, sha256, hash from records (page_id, file, offset, length, sha256).

    Leaves stand in the archive's order: by file and offset. Records without an id stand in no segment and are left out;
    those that repeat one are leaves of their own.
    """
    order = Window.partitionBy("segment").orderBy("file", "offset", "page_id", "sha256")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = records.filter("page_id is not null").select(F.floor(F.col("page_id") / SEGMENT).alias("segment"), "page_id", "file", "offset", F.col("length").cast("long").alias("length"), "sha256")
    placed = rows.withColumn("node", (F.row_number().over(order) - 1).cast("long")).withColumn("record_offset", F.coalesce(F.sum(F.col("length") + 4).over(before), F.lit(0)))
    return placed.withColumn("hash", F.sha2(F.concat_ws(":", "sha256", "record_offset", "length"), 256))


def trees(rows: DataFrame) -> list[DataFrame]:
    """Levels 0 (leaves) to LEVELS (roots) of the trees of rows (side, segment, node, hash), written once each. Beyond SEGMENT
    records (repeated ids) the top level takes the rest."""
    levels = [rows.select("side", "segment", "node", "hash")]
    for level in range(1, LEVELS + 1):
        parent = F.lit(0).cast("long") if level == LEVELS else F.floor(F.col("node") / FAN)
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"]), "")
        levels.append(materialize(levels[-1].groupBy("side", "segment", parent.alias("node")).agg(F.sha2(kids, 256).alias("hash"))))
    return levels


def differing(levels: list[DataFrame]) -> DataFrame:
    """Leaves (segment, node) that differ between the sides: roots are compared first, then only children of nodes that differ."""
    bad = None
    for level in range(LEVELS, -1, -1):
        nodes = levels[level]
        if bad is not None:
            up = F.lit(0).cast("long") if level + 1 == LEVELS else F.floor(F.col("node") / FAN)
            nodes = nodes.withColumn("parent", up).join(bad.withColumnRenamed("node", "parent"), ["segment", "parent"], "left_semi")
        both = nodes.groupBy("segment", "node").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        bad = materialize(both.filter((F.col("n") < 2) | (F.col("low") != F.col("high"))).select("segment", "node"))
    return bad


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Compare two replicas' records (page_id, length, sha256 and, of archives, file and offset; other columns are ignored):
    a row per record of either one, with its place in our archive (theirs where ours lacks it) to find it by.

    segment, ordinal, page_id, file, file_offset, record_offset, record_length, record_sha256, segment_root (ours; null where
    we have no such segment) and status: intact; corrupt (bytes differ); moved (the same bytes in
    another order among those that both have); missing (only theirs) or surplus (only ours). Stretches of our archive that can't be read are rows
    without segment and page_id and status unreadable. Records given without file and offset stand by page_id. Records that
    repeat an id are told apart by their order. Empty replicas give no rows.
    """

    def side(records: DataFrame, number: int) -> DataFrame:
        records = records.withColumns({c: F.lit(None).cast(k) for c, k in (("file", "string"), ("offset", "long")) if c not in records.columns})
        return leaves(records).withColumn("side", F.lit(number))

    both = materialize(side(ours, 0).unionByName(side(theirs, 1)), "side")
    levels = trees(both)
    bad = differing(levels)
    found = both.join(bad, ["segment", "node"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("side", "segment", "page_id").orderBy("node"))
    found = found.withColumn("nth", nth)
    places = ["node", "file", "offset", "record_offset", "length", "sha256"]
    mine = found.filter("side = 0").select("segment", "page_id", "nth", *places, F.lit(True).alias("a"))
    other = found.filter("side = 1").select("segment", "page_id", "nth", *(F.col(c).alias(f"b_{c}") for c in places), F.lit(True).alias("b"))
    pick = lambda c: F.when(F.col("a"), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c)
    same = F.col("sha256").eqNullSafe(F.col("b_sha256")) & (F.col("length") == F.col("b_length"))
    met = mine.join(other, ["segment", "page_id", "nth"], "full")
    # of the records that both have, a moved one has other ones before it
    common = F.col("a") & F.col("b")
    rank = lambda c: F.row_number().over(Window.partitionBy("segment", common).orderBy(c))
    met = met.withColumns({"rank_a": rank("node"), "rank_b": rank("b_node")})
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "surplus").when(~same, "corrupt").when(F.col("rank_a") == F.col("rank_b"), "intact").otherwise("moved")
    told = met.select("segment", "page_id", *map(pick, places), status.alias("status"))
    sound = both.filter("side = 0").join(bad, ["segment", "node"], "left_anti").select("segment", "page_id", *places, F.lit("intact").alias("status"))
    roots = levels[LEVELS].filter("side = 0").select("segment", F.col("hash").alias("segment_root"))
    rows = told.unionByName(sound).join(roots, "segment", "left")
    names = {"node": "ordinal", "offset": "file_offset", "length": "record_length", "sha256": "record_sha256"}
    rows = rows.withColumnsRenamed(names).select("segment", "ordinal", "page_id", "file", "file_offset", "record_offset", "record_length", "record_sha256", "status", "segment_root")
    if {"file", "offset"} <= set(ours.columns):
        none = lambda kind: F.lit(None).cast(kind)
        lost = ours.filter("page_id is null").select(none("long"), none("long"), none("long"), "file", "offset", none("long"), F.col("length").cast("long"), "sha256", F.lit("unreadable"), none("string"))
        rows = rows.union(lost)
    return rows

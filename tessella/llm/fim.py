"""Fill-in-middle transformation: texts are cut at two token ends and their parts put into another order.

Tokens are runs of A-Z and a-z, or single other characters. A text's token ends are a set of character offsets in
containers (boundaries.py), in which the two cuts are selected by their rank. Which cuts, and which form, follows from a
hash of the document's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessella.llm.boundaries import SPAN, Boundaries
from tessella.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of a hundred that are transformed, and how many of those begin with the suffix.
RATE, SPM = 90, 20
_OUT = {"_n": LongType(), "_form": StringType(), "_prefix": LongType(), "_middle": LongType(), "_output": StringType()}


def token_ends(text: str) -> Boundaries:
    """The offset after each token. A container's characters are looked at at a time, and the one after them."""
    found = Boundaries()
    for number in range(len(text) // SPAN + 1):
        begin = number * SPAN
        base = max(0, begin - 1)
        code = np.frombuffer(text[base : begin + SPAN].encode("utf-32-le"), np.uint32) | 32
        letter = np.append((code >= ord("a")) & (code <= ord("z")), False)
        offset = np.arange(max(begin, 1), min(begin + SPAN - 1, len(text)) + 1)
        # an offset ends a token unless letters stand on both sides of it
        found.add(number, offset[~(letter[offset - 1 - base] & letter[offset - base])] - begin)
    return found


def transformed(text: str, h: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, characters of prefix and middle, output."""
    ends = token_ends(text)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (ends.select(k - 1) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _cut(docs: DataFrame, seed: str, rate: int, spm: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of _OUT, and their names there, which no column of docs has."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    names = {c: fresh(docs, c) for c in _OUT}
    draws = fresh(docs, "_h")
    rows = docs.withColumn(draws, F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))))
    text, at, columns = docs.columns.index("text"), len(docs.columns), [*docs.columns, *names.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [transformed(t or "", h, rate, spm) for t, h in zip(batch.column(text).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], names=columns)

    schema = StructType([*docs.schema.fields, *(StructField(names[column], kind) for column, kind in _OUT.items())])
    return rows.mapInArrow(run, schema), names


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form: no part holds a mark, so each mark's first place is its own."""
    after = lambda mark: F.position(F.lit(mark), output) + len(mark)
    between = lambda a, b: F.substring(output, after(a), F.position(F.lit(b), output) - after(a))
    rest = F.substring(output, after(MIDDLE), F.char_length(output))
    return F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), rest, between(SUFFIX, MIDDLE))).when(form == "spm", F.concat(between(PREFIX, MIDDLE), rest, between(SUFFIX, PREFIX))).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    form: psm (prefix, suffix, middle), spm (suffix first) or plain (the text as it is: empty, with one of the marks in it, or not
    drawn). A null text counts as empty; a null id hashes as an empty one; rows that repeat an id are cut alike if their
    texts are equal; an empty table gives no rows; other columns are ignored. A text is held whole, its offsets by container.
    """
    cut, name = _cut(docs.select("doc_id", F.col("text").cast("string").alias("text")), seed, rate, spm)
    return cut.select("doc_id", F.col(name["_n"]).alias("n"), F.col(name["_form"]).alias("form"), F.col(name["_prefix"]).alias("prefix_chars"), F.col(name["_middle"]).alias("middle_chars"), F.col(name["_output"]).alias("output"))


def fill_in_middle_documents(docs: DataFrame, seed: str = "1", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with all its columns, text being fill_in_middle()'s output; null texts become empty ones."""
    cut, name = _cut(docs, seed, rate, spm)
    return cut.withColumn("text", F.col(name["_output"])).select(docs.columns)


__all__ = ["fill_in_middle", "fill_in_middle_documents", "restored", "token_ends"]

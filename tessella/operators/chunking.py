"""Cutting texts into overlapping character windows and sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import sanitize


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end): windows of size characters, ended at the last line end or sentence end past their half; the next
    one starts overlap characters before the end."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = max(text.rfind("\n", start, end), text.rfind(". ", start, end))
            end = at + (1 if text[at] == "\n" else 2) if at > start + size // 2 else end
        yield start, end
        if end >= len(text):
            return
        start = max(end - overlap, start + 1)


def chunk_pages(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, ord, start, chunk of every text, trimmed like the text itself; null and blank texts give no rows."""
    if not 0 <= overlap < size:
        raise ValueError("overlap is at least 0 and less than size")

    def cut(text: str | None) -> Iterator[tuple[int, str]]:
        plain = (text or "").strip()
        first = len(text or "") - len((text or "").lstrip())
        for a, b in windows(plain, size, overlap):
            if chunk := plain[a:b].strip():
                yield first + a + len(plain[a:b]) - len(plain[a:b].lstrip()), chunk

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, k, a, chunk) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for k, (a, chunk) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "start", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ord int, start long, chunk string")


def sections(text: str) -> Iterator[tuple[str, int, int]]:
    """(heading, start, end): the text before the first heading, if any, and every heading with what follows; lines of #
    marks within fences are no headings. The parts join to the whole text."""
    start, heading, at, fenced = 0, "", 0, False
    for line in text.splitlines(keepends=True):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and re.match(r"#+ ", line):
            if at > start:
                yield heading, start, at
            start, heading = at, line.lstrip("#").strip()
        at += len(line)
    if at > start:
        yield heading, start, at


def fitting(text: str, budget: int, length=lambda t: len(t.split())) -> Iterator[tuple[int, int]]:
    """(start, end): the longest prefixes whose length is within budget, found by bisection and cut back to the last line
    end or blank in their final fifth. Each takes one character at least; they join to the whole text."""
    start = 0
    while start < len(text):
        low, high = start + 1, min(len(text), start + 16 * budget)
        while high < len(text) and length(text[start:high]) <= budget:
            high = min(len(text), start + 2 * (high - start))
        while low < high:
            middle = (low + high + 1) // 2
            if length(text[start:middle]) <= budget:
                low = middle
            else:
                high = middle - 1
        end = low
        if end < len(text):
            floor = end - (end - start) // 5
            cut = max(text.rfind("\n", floor, end), text.rfind(" ", floor, end))
            end = cut + 1 if cut >= floor and cut + 1 > start else end
        yield start, end
        start = end


def _exploded(docs: DataFrame, parts, schema: str) -> DataFrame:
    """One row a part: doc_id, ord and what parts(text) yields; null and empty texts give none."""
    names = ["doc_id", "ord", *(c.split()[0] for c in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(d, k, *p) for d, t in zip(frame["doc_id"], frame["text"], strict=True) if t for k, p in enumerate(parts(t))], columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, ord int, {schema}")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, heading, start, body."""
    return _exploded(docs, lambda t: ((h, a, t[a:b]) for h, a, b in sections(t)), "heading string, start long, body string")


def embedding_chunks(docs: DataFrame, budget: int) -> DataFrame:
    """doc_id, ord, start, chunk of cleaned texts; starts count in the cleaned text."""
    clean = docs.select("doc_id", sanitize(F.col("text")).alias("text"))
    return _exploded(clean, lambda t: ((a, t[a:b]) for a, b in fitting(t, budget)), "start long, chunk string")

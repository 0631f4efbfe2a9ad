"""Reading units and structured chunks of texts, and which of ranked units are read, placed and packed."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.chunking import _exploded

Measure = Callable[[str], int]

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_WORD = re.compile(r"\S*\s|\S+")
_HEADING = re.compile(r"(#{1,6}) ")


def _is_row(line: str) -> bool:
    plain = line.strip()
    return plain.startswith("|") and plain.endswith("|")


def _is_rule(line: str) -> bool:
    inner = line.strip().strip("|")
    return "-" in inner and not set(inner) - set("|-: \t\r")


def _rows(lines: deque[str], budget: int) -> tuple[str, int]:
    """The next rows of a table within budget, one at least, and how many they are."""
    body, n = lines.popleft(), 1
    while lines and _is_row(lines[0]) and len(body) + len(lines[0]) <= budget:
        body, n = body + lines.popleft(), n + 1
    return body, n


def _paragraph(lines: deque[str], budget: int) -> str:
    """The next lines up to an empty one (included), a heading, a table or the budget; a longer line is cut between words."""
    line = lines.popleft()
    if len(line) > budget:
        end = 0
        for word in _WORD.finditer(line):
            if end and word.end() > budget:
                break
            end = word.end()
        if end < len(line):
            lines.appendleft(line[end:])
        return line[:end]
    body = line
    if line.strip().startswith("#"):
        return body
    while line.strip() and lines and not _is_row(lines[0]) and not lines[0].lstrip().startswith("#") and len(body) + len(lines[0]) <= budget:
        line = lines.popleft()
        body += line
    return body


def units(text: str, budget: int) -> Iterator[tuple]:
    """(kind, heading, table_id, row_start, row_end, start, body, prefix, oversized, table_header, start_byte) of a text; bodies
    join to the text, start and start_byte are a body's place in characters and in bytes of UTF-8.

    A prefix names the headings above a unit and repeats the header of a table whose earlier rows are in other units. Rows
    are never cut: what is over the budget is marked as oversized.
    """
    lines, above, tables, at, byte = deque(_LINE.findall(text)), [], 0, 0, 0

    def unit(kind: str, body: str, table: int | None = None, first: int | None = None, last: int | None = None, header: str = "") -> tuple:
        heading = "\n".join(line for _, line in above)
        prefix = f"{heading}\n\n" if heading and not body.startswith(heading) else ""
        prefix += header if first else ""
        return kind, heading, table, first, last, at, body, prefix, len(prefix) + len(body) > budget, header, byte

    while lines:
        if _is_row(lines[0]):
            tables, row = tables + 1, 0
            header = lines[0] + lines[1] if len(lines) > 1 and _is_rule(lines[1]) else ""
            while lines and _is_row(lines[0]):
                body, n = _rows(lines, budget)
                yield unit("table_rows", body, tables, row, row + n, header)
                row, at, byte = row + n, at + len(body), byte + len(body.encode())
            continue
        title = lines[0].strip()
        if mark := _HEADING.match(title):
            level = len(mark[1])
            above = [*((n, line) for n, line in above if n < level), (level, title)]
        body = _paragraph(lines, budget)
        yield unit("paragraph", body)
        at, byte = at + len(body), byte + len(body.encode())


def reading_units(docs: DataFrame, budget: int) -> DataFrame:
    """doc_id, ord and the units of every text; null and empty texts give none."""
    if budget < 1:
        raise ValueError("budget is at least 1")
    return _exploded(docs, lambda t: units(t, budget), "kind string, heading string, table_id int, row_start int, row_end int, start long, body string, prefix string, oversized boolean, table_header string, start_byte long")


def units_for_index(rows: DataFrame) -> DataFrame:
    """Without heading units that the next unit of the document repeats in its prefix."""
    body = F.trim(F.regexp_replace("body", r"^\s+|\s+$", ""))
    following = F.lead("prefix").over(Window.partitionBy("doc_id").orderBy("ord"))
    repeated = body.startswith("#") & (F.col("heading") == body) & F.startswith(F.col("_next"), body)
    return rows.withColumn("_next", following).filter(~F.coalesce(repeated, F.lit(False))).drop("_next")


#: How a clause begins.
CLAUSE = r"(?i)(?:#{1,6}\s+|(?:Пункт|Раздел|Статья|п\.|§)\s*\d+(?:\.\d+)+|\d+(?:\.\d+)+(?:\s+|\.|$))"
_CLAUSE = re.compile(CLAUSE)
_AFTER_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def clauses(text: str) -> list[str]:
    """Trimmed parts of a text, a new one at every line that begins a clause, indented or not."""
    parts: list[list[str]] = [[]]
    for line in _LINE.findall(text):
        if _CLAUSE.match(line.strip()):
            parts.append([])
        parts[-1].append(line)
    return [p for lines in parts if (p := "".join(lines).strip())]


def sentences(text: str) -> list[str]:
    return [s for s in _AFTER_SENTENCE.split(text.strip()) if s]


def _tail(text: str, overlap: int, measure: Measure, unit: int) -> str:
    """The last whole sentences of a chunk within overlap, each with a blank; without any the last characters of the last one."""
    kept, room, said = [], overlap, sentences(text)
    for s in reversed(said):
        if measure(s) + 1 > room:
            break
        kept.append(s)
        room -= measure(s) + 1
    return " ".join(reversed(kept)) if kept else said[-1][-overlap * unit :].strip()


def _packed(pieces: list[str], mark: str, size: int, overlap: int, finer: Callable[[str], Iterator[str]], measure: Measure, unit: int) -> Iterator[str]:
    held = ""
    for piece in pieces:
        if measure(piece) > size:
            if held:
                yield held
            held = ""
            yield from finer(piece)
        elif held and measure(held) + len(mark) + measure(piece) > size:
            yield held
            tail = _tail(held, overlap, measure, unit) if overlap else ""
            held = tail + mark + piece if tail else piece
        else:
            held = held + mark + piece if held else piece
    if held:
        yield held


def structured(text: str, size: int, overlap: int, measure: Measure = len) -> Iterator[str]:
    """Chunks of size: clauses joined by an empty line, longer ones by sentences, longer ones of these by overlapping slices. A
    chunk begins with the end of the one before, by which it may be longer. measure: what a text counts (its characters); for
    any other, slices have three characters a unit."""
    unit = 1 if measure is len else 3
    step = size * unit - min(overlap * unit, size * unit // 4)
    slices = lambda s: (s[k : k + size * unit] for k in range(0, len(s), step))
    finer = lambda c: _packed(sentences(c), " ", size, overlap, slices, measure, unit)
    return _packed(clauses(text), "\n\n", size, overlap, finer, measure, unit)


def chunk_structured(docs: DataFrame, size: int, overlap: int, measure: Measure = len) -> DataFrame:
    """doc_id, ord, chunk; null and blank texts give none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap is at least 0 and less than size")
    return _exploded(docs, lambda t: ((c,) for c in structured(t, size, overlap, measure)), "chunk string")


def row_cells(line: Column) -> Column:
    """Cells of a Markdown table row, trimmed; an escaped bar belongs to its cell."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def escaped_row(cells: Column) -> Column:
    """A Markdown table row of cells, in which bars are escaped and line ends are blanks."""
    plain = lambda c: F.replace(F.regexp_replace(c, r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, plain), " | "), F.lit(" |"))


def with_appendix(base: DataFrame, tables: DataFrame, keys: list[str], window: int, slots: int) -> DataFrame:
    """Ranked rows (keys, position from 1) with those of tables (keys, nth from 1) behind them, each once.

    If none of the tables is among the first window rows, the first slots of them take the window's last places. Both lists
    are a search's limit long, so one window holds them.
    """
    once = Window.orderBy(F.col("position").isNull(), "position", "nth")
    rows = base.join(tables, keys, "full").withColumn("place", F.row_number().over(once))
    known = F.col("nth").isNotNull()
    seen = F.min(F.when(known, F.col("place"))).over(Window.partitionBy())
    turn = F.row_number().over(Window.partitionBy(known).orderBy("nth", "place"))
    rows = rows.withColumn("_up", known & (seen > window) & (turn <= slots))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_up").orderBy(F.when(F.col("_up"), F.col("nth")), "place")))
    head = window - F.count_if("_up").over(Window.partitionBy())
    bucket = F.when(F.col("_up"), 1).when(F.col("_n") <= head, 0).otherwise(2)
    rows = rows.withColumn("_b", bucket)
    return rows.withColumn("final", F.row_number().over(Window.orderBy("_b", "_n"))).select(*keys, "position", "nth", "final")


def read_plan(pool: DataFrame, question: str, scope: list[str], most: int) -> DataFrame:
    """Of ranked anchors (position from 1, anchor true) and the expansion behind them: the rows of the first most scopes in
    order of first sight, all anchors' scopes in any case."""
    place = Window.partitionBy(question, *scope)
    rows = pool.withColumn("_first", F.min("position").over(place)).withColumn("_own", F.max(F.col("anchor")).over(place))
    rows = rows.withColumn("_nth", F.dense_rank().over(Window.partitionBy(question).orderBy("_first")))
    needed = F.max(F.when(F.col("_own"), F.col("_nth"))).over(Window.partitionBy(question))
    return rows.filter((F.col("_nth") <= most) | F.col("_own")).withColumn("scopes_needed", needed).drop("_first", "_own", "_nth")


def addressed(rows: DataFrame, sheet: list[str], owner: str, row: str) -> DataFrame:
    """Rows of sheets that one workbook owns alone, without those places that have more than one reading."""
    owned = rows.groupBy(*sheet).agg(F.min(owner).alias("_a"), F.max(owner).alias("_b")).filter("_a = _b").select(*sheet)
    single = rows.groupBy(*sheet, row).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(single, [*sheet, row], "left_semi").join(owned, sheet, "left_semi")


def packed_context(units: DataFrame, question: str, budget: int, least: int = 80) -> DataFrame:
    """Units (question, position, unit, size) that fit in order of position with two characters between them: a unit that is
    too long is cut to what is left if that is over least, else passed over. A question's units are a search's limit."""
    items = F.array_sort(F.collect_list(F.struct("position", "unit", F.col("size").cast("long").alias("size"))))
    empty = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<position:int,unit:string,took:long>>").alias("taken"))

    def add(state: Column, x: Column) -> Column:
        gap = F.when(state["total"] > 0, 2).otherwise(0).cast("long")
        left = F.lit(budget).cast("long") - state["total"] - gap
        took = F.when(x["size"] <= left, x["size"]).when(left > least, left).otherwise(F.lit(0).cast("long"))
        one = F.array(F.struct(x["position"].cast("int").alias("position"), x["unit"].cast("string").alias("unit"), took.alias("took")))
        more = F.struct((state["total"] + gap + took).alias("total"), F.concat(state["taken"], one).alias("taken"))
        return F.when(took > 0, more).otherwise(state)

    whole = units.groupBy(question).agg(F.aggregate(items, empty, add).alias("p"))
    return whole.select(question, F.explode("p.taken").alias("t")).select(question, "t.position", "t.unit", "t.took")


def pack_sections(objects: DataFrame, question: str, budget: int) -> DataFrame:
    """Sections of a context within a budget of tokens, a separator of one token before every object but the first.

    objects: question, kind (its place in the order of sections), required, position, id, tokens (1 or more), fallback (array
    of the tokens of smaller blocks, may be null). All required ones are taken first; if they don't fit they are returned
    alone, with overflow true. Others are taken in order as far as they fit, else those of their blocks that fit. Returns
    taken parts (part 0 is the whole, 1 is the first block) and, with part null, what was left out whole. A question's
    objects are a search's limit.
    """
    step = "struct<optional:boolean,kind:int,position:int,id:string,part:int,tokens:long>"
    blocks = F.concat(F.array("tokens"), F.coalesce("fallback", F.array().cast("array<bigint>")))
    steps = objects.select(question, (~F.col("required")).alias("optional"), "kind", "position", "id", F.posexplode(blocks).alias("part", "tokens"))
    steps = steps.filter(F.col("optional") | (F.col("part") == 0))
    items = F.array_sort(F.collect_list(F.struct("optional", "kind", "position", "id", "part", "tokens").cast(step)))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("refused"), F.array().cast(f"array<{step}>").alias("taken"))

    def add(state: Column, x: Column) -> Column:
        cost = x["tokens"] + F.when(state["used"] > 0, 1).otherwise(0)
        whole = x["part"] == 0
        fits = ~x["optional"] | ((whole | state["refused"]) & (state["used"] + cost <= budget))
        refused = F.when(whole, ~fits).otherwise(state["refused"])
        return F.struct((state["used"] + F.when(fits, cost).otherwise(0)).alias("used"), refused.alias("refused"), F.when(fits, F.concat(state["taken"], F.array(x))).otherwise(state["taken"]).alias("taken"))

    must = F.aggregate(F.filter("items", lambda x: ~x["optional"]), F.lit(-1).cast("long"), lambda n, x: n + x["tokens"] + 1)
    packed = steps.groupBy(question).agg(items.alias("items")).withColumn("overflow", must > budget)
    packed = packed.withColumn("taken", F.when(F.col("overflow"), F.filter("items", lambda x: ~x["optional"])).otherwise(F.aggregate("items", empty, add)["taken"]))
    held = F.transform("taken", lambda x: x["id"])
    left = F.filter("items", lambda x: ~F.col("overflow") & (x["part"] == 0) & ~F.array_contains(held, x["id"]))
    none = F.transform(left, lambda x: F.struct(x["optional"], x["kind"], x["position"], x["id"], F.lit(None).cast("int").alias("part"), F.lit(0).cast("long").alias("tokens")).cast(step))
    rows = packed.select(question, "overflow", F.explode(F.concat("taken", none)).alias("t"))
    return rows.select(question, "overflow", "t.kind", "t.id", "t.part", "t.tokens")


def topic_plan(topics: DataFrame, sections: DataFrame, files: DataFrame, scope: str, most_topics: int = 2, most_files: int = 10, most_sections: int = 12) -> tuple[DataFrame, DataFrame]:
    """Files and sections to read for each scope's best topics, as (sections, files), each once and in order of first sight.

    topics: scope, topic, score; sections: scope, topic, position, file, heading; files: scope, topic, position, file. A
    topic's sections come before its files, and name files also beyond the sections' own limit.
    """
    best = Window.partitionBy(scope).orderBy(F.desc("score"), "topic")
    chosen = topics.withColumn("_t", F.row_number().over(best)).filter(F.col("_t") <= most_topics).select(scope, "topic", "_t")

    def first(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
        once = rows.groupBy(scope, *keys).agg(F.min(F.struct("_t", "_leg", "position", "topic")).alias("_at"))
        nth = F.row_number().over(Window.partitionBy(scope).orderBy("_at", *keys))
        return once.withColumn("nth", nth).filter(F.col("nth") <= most).select(scope, "nth", *keys, F.col("_at.topic").alias("topic"), F.col("_at._leg").alias("leg"))

    named = sections.join(chosen, [scope, "topic"]).withColumn("_leg", F.lit(0))
    held = files.join(chosen, [scope, "topic"]).withColumn("_leg", F.lit(1))
    columns = [scope, "topic", "_t", "_leg", "position", "file"]
    return first(named, ["file", "heading"], most_sections), first(named.select(columns).union(held.select(columns)), ["file"], most_files)

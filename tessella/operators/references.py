"""References between texts, files and messages: mentions of numbers, named files, reply chains, and what of an answer fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import casefold
from tessella.operators.catalog import cut_lineage

#: A code: runs of letters and digits joined by single marks. A number is one with a digit and NUMBER characters or more.
CODE, NUMBER = r"[0-9A-Za-z]+(?:[._/-][0-9A-Za-z]+)*", 6
#: Signs of a file's name beside letters and digits, and the least length of a name without its extension that refers to it.
NAME, STEM = r"\p{L}\p{N}_-", 8


def numbers(text: Column) -> Column:
    """The numbers that a text mentions, in order, repeats included."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE), F.lit(0))
    return F.filter(found, lambda w: w.rlike("[0-9]") & (F.length(w) >= NUMBER))


def reference_edges(named: DataFrame, texts: DataFrame) -> DataFrame:
    """src, dst, weight: texts (doc_id, text) that mention a number of another document; weight counts the numbers.

    named: doc_id and number; the first document of a number owns it. One pass cuts the texts into numbers, each document's once,
    which meet the named ones by an equal key, of which each has one row, so that a number of many mentions can be split.
    """
    owner = named.filter("number is not null").groupBy("number").agg(F.min("doc_id").alias("dst"))
    said = texts.select(F.col("doc_id").alias("src"), F.explode(F.array_distinct(numbers(F.col("text")))).alias("number"))
    return said.join(owner, "number").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def plain_reference(text: Column) -> Column:
    """Case folded, with / between folders, without quotes, white space as single blanks."""
    out = F.translate(casefold(F.coalesce(text, F.lit(""))), "ё\\", "е/")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[«»\"'`]+", ""), r"\s+", " "))


def suffixes(path: Column) -> Column:
    """A plain path and what is left of it folder by folder, the file's name last."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.when(F.size(parts) > 0, ends).otherwise(F.array().cast("array<string>"))


def _runs(text: Column) -> Column:
    """(a, b) of a text's runs of a name's signs, from 1, b excluded."""
    marks = F.regexp_extract_all(text, F.lit(rf"[{NAME}]+|[^{NAME}]+"), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        end = s["at"] + F.length(m)
        return F.struct(end.alias("at"), F.when(m.rlike(rf"^[{NAME}]"), F.concat(s["out"], F.array(F.struct(s["at"].alias("a"), end.alias("b"))))).otherwise(s["out"]).alias("out"))

    return F.aggregate(marks, start, step, lambda s: s["out"])


def resolved(questions: DataFrame, files: DataFrame) -> DataFrame:
    """question_id, status (matched or ambiguous), matches, file_id (where matched), score of the files that questions name.

    questions: question_id, question; files: file_id, path. A question names a file by its path or the end of one (10,000 points), by
    its name (5,000) or its name without extension (1,000, if that has STEM characters), and a point for each character; it stands
    between signs that no name has. The files with most points are meant. Names meet by equal keys: the ends of paths are an
    index, and a question's candidates are its stretches of as many runs as any name has.
    """
    plain = files.select("file_id", plain_reference(F.col("path")).alias("path"))
    base = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    tier = lambda values, points: F.transform(values, lambda v: F.struct(v.alias("name"), (F.length(v) + points).alias("score")))
    names = F.concat(tier(suffixes(F.col("path")), 10_000), tier(F.array(base), 5_000), tier(F.filter(F.array(stem), lambda v: F.length(v) >= STEM), 1_000))
    index = plain.select("file_id", F.inline(F.filter(names, lambda n: n["name"] != ""))).groupBy("file_id", "name").agg(F.max("score").alias("score"))
    index = index.withColumn("runs", F.size(_runs(F.col("name")))).filter("runs > 0")
    most = index.agg(F.coalesce(F.max("runs"), F.lit(0))).first()[0]
    asked = questions.select("question_id", plain_reference(F.col("question")).alias("q")).withColumn("_runs", _runs(F.col("q")))
    pairs = F.flatten(F.transform("_runs", lambda x, i: F.transform(F.slice("_runs", i + 1, F.lit(max(most, 1))), lambda y: F.substring("q", x["a"], y["b"] - x["a"]))))
    said = asked.select("question_id", F.explode(F.array_distinct(pairs)).alias("name"))
    # names begin and end within runs: what stands before and after one is outside
    whole = index.filter(F.col("name").rlike(rf"^[{NAME}](.*[{NAME}])?$"))
    found = said.join(whole, "name").groupBy("question_id", "file_id").agg(F.max("score").alias("score"))
    best = found.groupBy("question_id").agg(F.max("score").alias("score")).join(found, ["question_id", "score"])
    told = best.groupBy("question_id", "score").agg(F.count(F.lit(1)).alias("matches"), F.min("file_id").alias("file_id"))
    status = F.when(F.col("matches") == 1, "matched").otherwise("ambiguous")
    return told.select("question_id", status.alias("status"), "matches", F.when(F.col("matches") == 1, F.col("file_id")).alias("file_id"), "score")


def reply_edges(messages: DataFrame) -> DataFrame:
    """message, reply_to: of messages (id, in_reply_to, refs, an array from the oldest on) the one that it answers, if it is known,
    else the last of its references that is."""
    known = messages.filter("id is not null").select(F.col("id").alias("ref")).distinct()
    asked = F.concat(F.transform(F.coalesce("refs", F.array().cast("array<string>")), lambda r, i: F.struct(i.alias("at"), r.alias("ref"))), F.array(F.struct(F.lit((1 << 31) - 1).alias("at"), F.col("in_reply_to").alias("ref"))))
    rows = messages.select(F.col("id").alias("message"), F.explode(asked).alias("x")).select("message", "x.at", "x.ref").filter("ref is not null")
    return rows.join(known, "ref").groupBy("message").agg(F.max_by("ref", "at").alias("reply_to"))


def roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """id, root of messages (id, up): the end of the chain of ups, which may be a message that isn't there; in a cycle, and above
    one, its least id. ids are unique, a null up is none.

    Every round each message jumps to where its up points, so chains are halved; what still moves after as many rounds as any
    chain without a cycle needs is on the way into one.
    """
    state = cut_lineage(links.select("id", F.coalesce("up", "id").alias("to"), F.least("id", F.coalesce("up", "id")).alias("low"), F.col("up").isNotNull().alias("moves")))
    total = state.count()
    for _ in range(min(rounds, max(1, total.bit_length() + 1))):
        onward = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("moves").alias("_moves"))
        # who has arrived, or points at no message, is not joined again
        still = state.filter("moves").join(onward, "to", "left")
        after = still.select("id", F.coalesce("_to", "to").alias("to"), F.least("low", F.coalesce("_low", "low")).alias("low"), (F.coalesce("_moves", F.lit(False)) & F.col("_to").isNotNull()).alias("moves"))
        state = cut_lineage(state.filter("not moves").unionByName(after))
        if state.filter("moves").isEmpty():
            break
    # whoever still moves stands, after that many steps, on a cycle whose members all have seen its least id
    ring = state.filter("moves")
    on = ring.join(state.select(F.col("id").alias("to"), F.col("low").alias("_low")), "to").select("id", F.col("_low").alias("root"))
    return state.filter("not moves").select("id", F.col("to").alias("root")).unionByName(on)


def fitted(parts: DataFrame, key: str, chars: int, items: int, units: int, base: int = 2) -> DataFrame:
    """The parts of each key's answer that fit its three limits at once, with their place (from 1) and the characters up to them.

    parts: key, kind (0 passages, 1 aliases, 2 traces), rank, unit (what a passage counts as, null for others), body (as it is
    sent). Parts are given up from the end: traces, then aliases, then passages, the last of each first, until all that is
    left fits. A part costs its characters and a comma, an answer base ones; nothing is cut.
    """
    order = Window.partitionBy(key).orderBy("kind", "rank")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # more than items parts never fit, so that many of a key are sorted at most
    rows = parts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= items)
    first = F.row_number().over(Window.partitionBy(key, "unit").orderBy("kind", "rank")) == 1
    rows = rows.withColumn("_new", (F.col("unit").isNotNull() & first).cast("int"))
    used = F.lit(base - 1) + F.sum(F.length("body") + 1).over(so_far)
    return rows.withColumns({"used": used, "units": F.sum("_new").over(so_far)}).filter((F.col("used") <= chars) & (F.col("units") <= units)).drop("_new")

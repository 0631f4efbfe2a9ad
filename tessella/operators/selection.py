"""Selection of context: units that cover a question and say little twice, under limits on characters, items and sources.

Everything that a unit has by itself is columns: equal contents are merged, the question's terms weighed over unique contents,
and each unit's score bounded from above, as novelty only falls and redundancy only rises while units are chosen. Texts are
never shuffled or stored: the merged table holds a digest, sizes and the question's terms that a unit matches, and where a
unit's other terms are needed it is looked up in `units`, which are therefore read once a round and have to be the same each time.

The choice itself is greedy, and lazy: a priority queue holds bounds, and only the unit on top is scored anew. A question's group
is its best units by bound; a choice is final only while it beats the bound of the best unit left out. Questions for which one
doesn't go into another round, with a score that a unit of the last group reaches: whatever can reach it without regard to
redundancy is looked up and scored against what was chosen so far, so a round adds a choice at least, the first of equal ones
by position. So the result is that of the whole candidate set, and no task holds it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.catalog import cut_lineage, discard, written

#: Characters that a unit's header takes besides its heading and source.
HEADER = 80
#: Units of a question in a round.
FIRST = 512
#: Rows that are broadcast at most: of questions with what was chosen for them, and of units without their texts.
FEW, SOME = 2_000, 200_000
#: By how much a bound may fall short for rounding.
SLACK = 1e-9


class Limits(NamedTuple):
    """max_chars: of units with their headers; text_chars: of texts alone (None: the same); reserve: of a header at least.
    peers: for a packer that owns the budget, limits on characters are left to it, and units of one group are redundant where
    several groups match the same terms best."""

    max_chars: int
    text_chars: int | None = None
    items: int = 32
    sources: int = 64
    reserve: int = 0
    peers: bool = False


def _digest(heading: Column, text: Column) -> tuple[Column, Column]:
    """A text without what white space alone tells apart, and the digest of it and its heading."""

    def plain(value: Column) -> Column:
        lines = F.transform(F.split(F.coalesce(value, F.lit("")), r"\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))
        return F.array_join(F.filter(lines, lambda line: line != ""), "\n")

    return plain(text), F.sha2(F.concat_ws("\0", plain(heading), plain(text)), 256)


def content_key(heading: Column, text: Column) -> Column:
    """Equal for units whose lines have the same words; empty where the text has none. Case, marks and digits count."""
    plain, digest = _digest(heading, text)
    return F.when(plain != "", digest).otherwise(F.lit(""))


def _few(df: DataFrame, most: int) -> DataFrame:
    """df (written), broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def _once(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows (of units) without what repeats a (source, unit_id) of its question; only those whose hash repeats are sorted."""
    name = F.xxhash64("question_id", "source", "unit_id").alias("_unit")
    again = cut_lineage(units.select(name).groupBy("_unit").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_unit"))
    if again.isEmpty():
        return rows
    first = F.row_number().over(Window.partitionBy("question_id", "source", "unit_id").orderBy("position"))
    named, again = rows.withColumn("_unit", name), _few(again, SOME)
    some = named.join(again, "_unit", "left_semi").withColumn("_n", first).filter("_n = 1").drop("_n")
    return named.join(again, "_unit", "left_anti").unionByName(some).drop("_unit")


def _by_content(rows: DataFrame, own: list[str]) -> DataFrame:
    """question_id, content, position and own columns of the first unit of a content, the least rank and source_rank, and copies."""
    kept = F.min(F.struct("position", *own)).alias("u")
    whole = rows.groupBy("question_id", "content").agg(kept, F.min("rank").alias("rank"), F.min("source_rank").alias("source_rank"), (F.count(F.lit(1)) - 1).alias("copies"))
    return whole.select("question_id", "content", "u.*", "rank", "source_rank", "copies")


def merged(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units to choose from, and where their contents are found.

    units: question_id, position (the order in which they came), source, unit_id, grp (null: the source), heading, text, rank and
    source_rank (null: none). Repeated (source, unit_id) and units without words go; of equal contents the first stays, with
    the least rank and source_rank of all, and `copies` of it. Provenance has question_id, content, source, unit_id, grp of every
    unit whose content was kept, a row each, as copies may be many.
    """
    rows = units.withColumn("grp", F.coalesce("grp", "source")).withColumn("content", content_key(F.col("heading"), F.col("text"))).filter("content <> ''")
    rows = _once(rows, units)
    return _by_content(rows, ["source", "unit_id", "grp", "heading", "text"]), rows.select("question_id", "content", "source", "unit_id", "grp")


def _terms() -> Column:
    return X.tokens(F.concat_ws("\n", F.coalesce("heading", F.lit("")), "text"))


def _content() -> Column:
    return F.unhex(_digest(F.col("heading"), F.col("text"))[1])


def _narrow(units: DataFrame, questions: DataFrame, limits: Limits) -> DataFrame:
    """merged() units without texts: content (in bytes), size, cost and matched, the question's terms in order, instead.
    questions: question_id, question."""
    asked = _few(cut_lineage(questions.select("question_id", F.array_distinct(X.tokens(F.col("question"))).alias("asked"))), SOME)
    header = F.greatest(F.length(F.coalesce("heading", F.lit(""))) + F.length("source") + HEADER, F.lit(limits.reserve))
    size, matched = F.length("text"), F.array_sort(F.array_intersect("asked", _terms()))
    own = {"grp": F.coalesce("grp", "source"), "content": _content(), "size": size, "cost": size + header, "matched": matched}
    rows = units.filter(F.col("text").rlike(r"\S")).join(asked, "question_id").withColumns(own).drop("heading", "text", "asked")
    return _by_content(_once(rows, units), ["grp", "size", "cost", "matched"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _weights(rows: DataFrame) -> DataFrame:
    """question_id and weights, of its terms that any unit has."""
    count = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    held = rows.select("question_id", F.explode("matched").alias("term")).groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("df")).join(count, "question_id")
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = held.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight"))))).alias("weights"))  # a question's terms
    return count.join(weights, "question_id", "left").select("question_id", F.coalesce("weights", F.create_map().cast("map<string,double>")).alias("weights"))


def _texts(limits: Limits) -> int:
    return limits.text_chars if limits.text_chars is not None else limits.max_chars


def weighed(rows: DataFrame, limits: Limits) -> DataFrame:
    """_narrow() rows with weights that may be chosen, with whole (the weights' sum), cover, relevance and load."""
    whole = _total(F.map_values("weights"))
    rows = rows.withColumn("whole", whole)
    rows = rows.withColumn("cover", F.when(F.col("whole") > 0, _total(F.transform("matched", lambda t: F.element_at("weights", t))) / F.col("whole")).otherwise(0.0))
    prior = F.when(F.col("rank").isNotNull(), 10.0 / (10.0 + F.col("rank"))).otherwise(F.coalesce(10.0 / (10.0 + F.col("source_rank")) * F.col("cover"), F.lit(0.0)))
    load = F.sqrt(1 + F.greatest(F.col("cost") / max(1, limits.max_chars), F.col("size") / max(1, _texts(limits))))
    rows = rows.withColumns({"relevance": 0.35 * prior + 0.65 * F.col("cover"), "load": load})
    if not limits.peers:
        rows = rows.filter((F.col("cost") <= limits.max_chars) & (F.col("size") <= _texts(limits)))
    return rows.filter("relevance <> 0")


def _peers(rows: DataFrame) -> DataFrame:
    """question_id, grp and peer: whether a group's best-covering unit matches just the terms that another group's does."""
    best = rows.groupBy("question_id", "grp").agg(F.max(F.struct("cover", (-F.col("position")).alias("early"), "matched")).alias("b")).select("question_id", "grp", F.col("b.matched").alias("best"))
    times = best.groupBy("question_id", "best").agg((F.count(F.lit(1)) > 1).alias("peer"))
    return best.join(times, ["question_id", "best"]).drop("best")


class Unit(NamedTuple):
    position: int
    group: str
    terms: frozenset[str]
    matched: frozenset[str]
    relevance: float
    cost: int
    size: int
    load: float
    peer: bool
    bound: float


def novelty(unit: Unit, covered: set[str], weights: dict[str, float], whole: float) -> float:
    return sum(w for t, w in weights.items() if t in unit.matched and t not in covered) / whole


def redundancy(unit: Unit, chosen: Unit) -> float:
    if unit.peer and unit.group == chosen.group:
        return 1.0
    both = len(unit.terms & chosen.terms)
    return both / max(1, len(unit.terms) + len(chosen.terms) - both)


def score(unit: Unit, new: float, same: float, whole: float) -> float:
    return (0.7 * unit.relevance + 0.3 * new - 0.3 * same) / unit.load if whole else unit.relevance


def lazily(units: list[Unit], weights: dict[str, float], limits: Limits, beyond: float | None, before: list[Unit] = (), certain: bool = False) -> tuple[list[tuple[int, float]], bool]:
    """(position, score) of the units chosen after those of before, in order, and whether that is all; units whose bounds are at
    most `beyond` (None: there are none) don't change what is returned, but may be what follows. certain: the first of units
    is known to be the next choice."""
    found, sure, _ = _chosen(units, weights, limits, beyond, before, certain)
    return [(units[i].position, value) for i, value in found], sure


def _chosen(units: list[Unit], weights: dict[str, float], limits: Limits, beyond: float | None, before: list[Unit], certain: bool) -> tuple[list[tuple[int, float]], bool, float | None]:
    """lazily() with places in units; and, where that isn't all, a score that as many units reach as may still be chosen, or as are left."""
    whole, chosen, out = sum(weights.values()), list(before), []
    covered, groups = set().union(*(c.terms for c in chosen)), {c.group for c in chosen}
    left = limits.max_chars - sum(c.cost for c in chosen)
    text_left = _texts(limits) - sum(c.size for c in chosen)

    def now(unit: Unit, same: float) -> float:
        return score(unit, novelty(unit, covered, weights, whole) if whole else 0.0, same, whole)

    def fits(unit: Unit) -> bool:
        return (limits.peers or (unit.cost <= left and unit.size <= text_left)) and (unit.group in groups or len(groups) < limits.sources)

    def take(i: int, value: float) -> None:
        nonlocal covered, left, text_left
        unit = units[i]
        chosen.append(unit)
        out.append((i, value))
        groups.add(unit.group)
        covered |= unit.terms
        left, text_left = left - unit.cost, text_left - unit.size

    start = 0
    if certain and units and len(chosen) < limits.items:
        start = 1
        take(0, now(units[0], max([0.0, *(redundancy(units[0], c) for c in chosen)])))
    # values are bounds; a unit was scored against the first `seen` of the chosen (-1: never), with `same` its redundancy
    queue = [(-u.bound - SLACK, u.position, -1, 0.0, i) for i, u in enumerate(units) if i >= start]
    heapq.heapify(queue)
    while len(chosen) < limits.items and queue:
        value, position, seen, same, i = heapq.heappop(queue)
        unit = units[i]
        if not fits(unit):
            continue  # it won't fit later either
        if seen < len(chosen):
            same = max([same, *(redundancy(unit, c) for c in chosen[max(seen, 0) :])])
            heapq.heappush(queue, (-now(unit, same), position, len(chosen), same, i))
            continue
        if beyond is not None and -value <= beyond + SLACK:
            heapq.heappush(queue, (value, position, seen, same, i))
            break
        take(i, -value)
    if beyond is None or len(chosen) >= limits.items:
        return out, True, None
    rest = [units[q[-1]] for q in queue if fits(units[q[-1]])]
    scores = sorted((now(u, max([0.0, *(redundancy(u, c) for c in chosen)])) for u in rest), reverse=True)[: limits.items - len(chosen)]
    return out, False, scores[-1] - 2 * SLACK if scores else None


_UNIT = ("position", "grp", "terms", "matched", "relevance", "cost", "size", "load", "peer", "bound")
_NAMED = ("source", "unit_id", "copies", "content")


def _unit(r: dict) -> Unit:
    return Unit(r["position"], r["grp"], frozenset(r["terms"]), frozenset(r["matched"]), r["relevance"], r["cost"], r["size"], r["load"], bool(r["peer"]), r["bound"])


def _round(limits: Limits, most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for question, rows, weights, before, least, beyond in zip(frame["question_id"], frame["units"], frame["weights"], frame["before"], frame["least"], frame["beyond"], strict=True):
                beyond = None if pd.isna(beyond) else beyond
                rows = list({r["position"]: r for r in reversed(rows)}.values())[::-1]  # in order, once each
                if len(rows) > most:
                    beyond = rows[most]["bound"] if beyond is None else max(beyond, rows[most]["bound"])
                chosen = [_unit(r) for r in before]
                found, sure, reached = _chosen([_unit(r) for r in rows[:most]], dict(weights), limits, beyond, chosen, not chosen or not pd.isna(least))
                picked = [rows[i] for i, _ in found]
                # a row without a position says how a round ended
                out = {"question_id": question, "nth": [len(found), *range(len(chosen) + 1, len(chosen) + len(found) + 1)], "score": [reached, *(s for _, s in found)], "sure": sure}
                out |= {c: pd.Series([None, *(r[c] for r in picked)], dtype=object) for c in (*_UNIT, *_NAMED)}
                yield pd.DataFrame(out)

    return run


def _open(questions: DataFrame, done: DataFrame | None, weights: DataFrame, kinds: str) -> DataFrame:
    """questions (question_id and least, a score that is reached) with their weights and what done has for them, written."""
    if done is None:
        rows = questions.withColumn("before", F.array().cast(kinds))
    else:
        listed = done.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct(*_UNIT).alias("u")))).alias("before"))  # at most limits.items
        rows = questions.join(listed, "question_id", "left").withColumn("before", F.coalesce(F.transform("before", lambda c: c["u"]).cast(kinds), F.array().cast(kinds)))
    taken = lambda name: F.transform("before", lambda c: c[name])
    used = lambda name: F.aggregate(taken(name), F.lit(0).cast("long"), lambda a, x: a + x)
    state = {"covered": F.array_distinct(F.flatten(taken("terms"))), "groups": F.array_distinct(taken("grp")), "taken": taken("position"), "used_cost": used("cost"), "used_size": used("size")}
    return cut_lineage(rows.join(weights, "question_id").withColumns(state))


def _score(new: Column, same: Column) -> Column:
    return F.when(F.col("whole") > 0, (0.7 * F.col("relevance") + 0.3 * new - 0.3 * same) / F.col("load")).otherwise(F.col("relevance"))


def _bounded(rows: DataFrame, state: DataFrame, limits: Limits) -> DataFrame:
    """rows of the questions of state (_open()) that may still be chosen, bounded by their score without redundancy."""
    rows = weighed(rows.join(state, "question_id"), limits)
    keep = ~F.array_contains("taken", F.col("position")) & (F.array_contains("groups", F.col("grp")) | (F.size("groups") < limits.sources))
    if not limits.peers:
        keep = keep & (F.col("used_cost") + F.col("cost") <= limits.max_chars) & (F.col("used_size") + F.col("size") <= _texts(limits))
    new = _total(F.transform(F.array_except("matched", "covered"), lambda t: F.element_at("weights", t))) / F.col("whole")
    own = ["question_id", "position", "content", "copies", "grp", "matched", "relevance", "cost", "size", "load", "peer", "whole", "least"]
    return rows.filter(keep).withColumns({"new": new, "most": _score(new, F.lit(0.0))}).select(*own, "new", "most")


def _scored(some: DataFrame, units: DataFrame, state: DataFrame) -> DataFrame:
    """some (_bounded() rows) with source, unit_id and terms of their units, bounded by their score against what was chosen."""
    texts = units.select("question_id", "position", "source", "unit_id", "heading", "text")
    same = F.array_contains(F.array("content"), _content())  # not an equality, which would be a key of the join, had from every text
    rows = texts.join(some, ["question_id", "position"]).filter(same)
    rows = rows.withColumn("terms", F.array_distinct(_terms())).drop("heading", "text").join(state.select("question_id", "before"), "question_id")

    def redundant(c: Column) -> Column:
        ratio = lambda both: both / F.greatest(F.lit(1), F.size(c["terms"]) + F.size("terms") - both)
        shared = F.get(F.transform(F.array(F.size(F.array_intersect(c["terms"], F.col("terms")))), ratio), F.lit(0))
        return F.when(F.col("peer") & (c["grp"] == F.col("grp")), 1.0).otherwise(shared)

    same = F.coalesce(F.array_max(F.transform("before", redundant)), F.lit(0.0))
    return rows.withColumn("bound", _score(F.col("new"), same)).drop("before").filter("least IS NULL OR bound >= least")


def select_context(units: DataFrame, questions: DataFrame, limits: Limits, first: int = FIRST) -> DataFrame:
    """question_id, nth (from 1), position, source, unit_id, grp, copies, content, score of the units chosen for each question.

    Ties go to the smaller position, which is a unit's own within its question. Questions without units give no rows.
    """
    rows = stored = written(_narrow(units, questions, limits))
    weights = cut_lineage(_weights(rows))
    if limits.peers:
        peers = _peers(weighed(rows.join(_few(weights, FEW), "question_id"), limits))
        rows = written(rows.join(peers, ["question_id", "grp"]))
        discard(stored)
    else:
        rows = rows.withColumn("peer", F.lit(False))
    kinds = dict(units.dtypes) | dict(rows.dtypes) | {"terms": "array<string>", "content": "string"} | dict.fromkeys(("relevance", "load", "bound"), "double")
    struct = "array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in _UNIT) + ">>"
    columns = ", ".join(f"{c} {kinds[c]}" for c in ("question_id", *_UNIT, *_NAMED)) + ", nth int, score double, sure boolean"
    state, done, reached, unreached = _open(weights.select("question_id", F.lit(None).cast("double").alias("least")), None, weights, struct), None, 0, 1
    while True:
        known = _few(state, FEW)
        bounded = _bounded(rows, known, limits)
        best = Window.partitionBy("question_id").orderBy(F.col("most").desc(), "position")
        some = bounded.filter("most >= least")
        if unreached:
            top = bounded.filter("least IS NULL").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= first + 1).drop("_n")
            some = top.unionByName(some) if reached else top
        some = written(some)
        best = Window.partitionBy("question_id").orderBy(F.col("bound").desc(), "position")
        held = _scored(_few(some, SOME), units, known).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= first + 1)
        held = held.withColumn("content", F.lower(F.hex("content")))
        beyond = F.coalesce(F.first("least"), F.when(F.count(F.lit(1)) > first, F.min("most"))).alias("beyond")
        groups = held.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", *_UNIT, *_NAMED))).alias("units"), beyond)  # first + 1 units
        groups = groups.join(known.select("question_id", "weights", "before", "least"), "question_id")
        found = cut_lineage(groups.mapInPandas(_round(limits, first), columns))
        discard(some)
        picked = found.filter("position IS NOT NULL").drop("sure")
        done = picked if done is None else done.unionByName(picked)
        ended = found.filter("position IS NULL AND NOT sure").select("question_id", F.col("score").alias("least"))
        reached, unreached = ended.agg(F.count("least"), F.count_if(F.col("least").isNull())).first()
        if not reached and not unreached:
            break
        state = _open(ended, done, weights, struct)
    discard(rows if limits.peers else stored)
    return done.select("question_id", "nth", "position", "source", "unit_id", "grp", "copies", "content", F.round("score", 6).alias("score"))

"""Dense and sparse vectors: exact nearest neighbours, grouped neighbours, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter one's components."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def neighbours(vectors: DataFrame, query: list[float], limit: int, id_col: str = "vec_id", least: float | None = None) -> DataFrame:
    """id and score of the rows nearest to one query vector by cosine, then id; least: a score threshold."""
    rows = vectors.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query))), 6))
    rows = rows if least is None else rows.filter(F.col("score") >= least)
    return rows.orderBy(F.col("score").desc(), id_col).limit(limit)


def neighbour_groups(vectors: DataFrame, query: list[float], group: str, groups: int, group_size: int, id_col: str = "vec_id") -> DataFrame:
    """The best groups by their best row, with each one's best rows."""
    rows = vectors.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query))), 6))
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), id_col)
    best = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= group_size)
    heads = best.filter("nth = 1").orderBy(F.col("score").desc(), id_col).limit(groups).select(group)
    return best.join(heads, group, "left_semi")


def query_vector(vectors: DataFrame, vec_id: int) -> list[float]:
    row = vectors.filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def maxsim(column: Column, query: list[float], rows: int) -> Column:
    """Late interaction of flat vectors of rows parts: the best inner product of every part of query, summed."""
    width = len(query) // rows
    parts = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda j: F.transform(F.slice(column, j * width + 1, F.lit(width)), lambda x: x.cast("double")))
    best = lambda part: F.array_max(F.transform(parts, lambda p: F.aggregate(F.zip_with(p, part, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    total = F.lit(0.0)
    for i in range(rows):
        total = total + best(F.array(*(F.lit(float(x)) for x in query[i * width : (i + 1) * width])))
    return total


def payload_filter(must: list[Column] = (), must_not: list[Column] = (), should: list[Column] = ()) -> Column:
    """All of must, none of must_not and, if there are any, one of should; an unknown condition counts as not met."""
    met = lambda c: F.coalesce(c, F.lit(False))
    out = F.lit(True)
    for c in must:
        out = out & met(c)
    for c in must_not:
        out = out & ~met(c)
    if should:
        one = F.lit(False)
        for c in should:
            one = one | met(c)
        out = out & one
    return out


def scroll(points: DataFrame, cursor: int | None, limit: int, keep: Column | None = None, id_col: str = "vec_id") -> DataFrame:
    """The next limit rows after the id cursor."""
    rows = points if keep is None else points.filter(keep)
    return (rows if cursor is None else rows.filter(F.col(id_col) > cursor)).orderBy(id_col).limit(limit)


def reuse(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """texts (doc_id, key) with reused_from: the smallest id of cached (doc_id, key) that has the key, or null."""
    owners = cached.groupBy("key").agg(F.min("doc_id").alias("reused_from"))
    return texts.join(owners, "key", "left")

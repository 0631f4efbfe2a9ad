"""Term counts and statistics of a table of texts, sparse vectors, corrections, and incremental maintenance of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import tokens

K1, B = 1.2, 0.75


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, term, tf."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.size(tokens(F.col(text_col))).cast("long").alias("length"))


def frequencies(counts: DataFrame) -> DataFrame:
    """term, df from term_counts()."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def updated(counts: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term_counts, frequencies) after the documents of removed (doc) left and those of added (doc, term, tf) came in or
    replaced theirs; frequencies change by the signed sum of what left and came."""
    gone = removed.select("doc").union(added.select("doc")).distinct()
    out = counts.join(gone, "doc", "left_semi")
    after = counts.join(gone, "doc", "left_anti").unionByName(added)
    return after, frequencies_after(counts, out, added)


def frequencies_after(counts: DataFrame, out: DataFrame, added: DataFrame) -> DataFrame:
    """term, df of counts after the rows of out (some of counts') left and those of added came: signed sums, which tasks
    make of their own rows first, so that no row of counts is shuffled."""
    signed = [t.select("term", F.lit(d).alias("d")) for t, d in ((counts, 1), (out, -1), (added, 1))]
    return signed[0].union(signed[1]).union(signed[2]).groupBy("term").agg(F.sum("d").alias("df")).filter("df > 0")


def weighted_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, term, weight: a term's saturated frequency with the mean length as it is now, for an index that keeps it."""
    words = docs.select(id_col, F.explode(F.array(tokens(F.col(text_col)))).alias("_words"))
    mean = words.agg(F.avg(F.size("_words"))).first()[0] or 1.0
    counts = words.select(id_col, F.size("_words").alias("_length"), F.explode("_words").alias("term")).groupBy(id_col, "_length", "term").agg(F.count(F.lit(1)).alias("_tf"))
    weight = F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_length") / mean))
    return counts.select(id_col, "term", weight.alias("weight"))


def sparse_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, index, value: terms as 31 bits of their CRC-32, valued by their counts."""
    index = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, index.alias("index")).agg(F.count(F.lit(1)).alias("value"))


def sparse_dot(vectors: DataFrame, query: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, score: inner products with one query vector (index, value) that share an index."""
    return vectors.join(query.select("index", F.col("value").alias("_q")), "index").groupBy(id_col).agg(F.sum(F.col("value") * F.col("_q")).alias("score"))


def _deletions(word: Column) -> Column:
    """A word and what is left of it without one or two of its characters."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = less(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, less))))


def corrections(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, known, distance: for words (word) that a dictionary (known) lacks the nearest entry, of equals the first: one
    edit away, or two for words of seven characters and more. Both hold distinct words of four characters or more.

    Words at most two edits apart share what is left after deleting two characters at most, so candidates come from an
    equality join on that, and no word meets the whole dictionary.
    """
    lacking = words.join(dictionary, words["word"] == dictionary["known"], "left_anti")
    left = lacking.select("word", F.explode(_deletions(F.col("word"))).alias("_key"))
    right = dictionary.select("known", F.explode(_deletions(F.col("known"))).alias("_key"))
    pairs = left.join(right, "_key").select("word", "known").distinct().withColumn("distance", F.levenshtein("word", "known"))
    near = pairs.filter(F.col("distance") <= F.when(F.length("word") <= 6, 1).otherwise(2))
    return near.groupBy("word").agg(F.min(F.struct("distance", "known")).alias("x")).select("word", "x.known", "x.distance")

"""Russian stems by the published Snowball rules, as column expressions over distinct words.

Every step cuts an ending off a region of the word, so that a word is its untouched beginning, the region after the first vowel, and
the place in it where the second region starts. Words that aren't all Cyrillic letters, such as codes, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import tokens

# Vowels and endings. Those of a first group count only after а or я.
VOWELS = "аеиоуыэюя"
GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
REFLEXIVE = "ся сь"
VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
SUPERLATIVE = "ейш ейше"
DERIVATIONAL = "ост ость"


def pattern(*groups: str) -> str:
    """The longest of some endings, which is the one that a search from the left meets first."""
    return "(?:" + "|".join(sorted(" ".join(groups).split(), key=lambda e: (-len(e), e))) + ")$"


def _cut(rv: Column, ending: Column) -> Column:
    return F.substring(rv, F.lit(1), F.length(rv) - F.length(ending))


def _ending(rows: DataFrame, name: str, source: str, after: str, free: str = "") -> DataFrame:
    """rows with name, the ending that source loses: the longest of both groups, none if it is of the first and no а or я precedes."""
    found = F.regexp_extract(source, pattern(after, free), 0)
    rows = rows.withColumn(name, found)
    first = F.col(name).isin(after.split())
    return rows.withColumn(name, F.when(~first | _cut(F.col(source), F.col(name)).rlike("[ая]$"), F.col(name)).otherwise(F.lit("")))


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """words with stem; null gives null. Each step is a column of its own, as later ones read it more than once."""
    own = words.withColumn("_w", F.replace(F.col(word), F.lit("ё"), F.lit("е")))
    v = f"[{VOWELS}]"
    rv = F.regexp_extract("_w", f"^[^{VOWELS}]*{v}(.*)$", 1)
    r2 = F.regexp_extract(F.regexp_extract("_w", f"^.*?{v}[^{VOWELS}](.*)$", 1), f"^.*?{v}[^{VOWELS}](.*)$", 1)
    rows = own.withColumns({"_rv": rv, "_r2": F.length(rv) - F.length(r2)}).withColumn("_head", _cut(F.col("_w"), F.col("_rv")))
    rows = _ending(rows, "_gerund", "_rv", *GERUND)
    # a gerund's ending is all that the first step cuts
    rows = rows.withColumn("_plain", F.regexp_replace("_rv", pattern(REFLEXIVE), ""))
    rows = rows.withColumn("_adjective", F.regexp_extract("_plain", pattern(ADJECTIVE), 0)).withColumn("_noun", F.regexp_extract("_plain", pattern(NOUN), 0))
    rows = rows.withColumn("_left", _cut(F.col("_plain"), F.col("_adjective")))
    rows = _ending(_ending(rows, "_participle", "_left", *PARTICIPLE), "_verb", "_plain", *VERB)
    first = (
        F.when(F.col("_gerund") != "", _cut(F.col("_rv"), F.col("_gerund"))).when(F.col("_adjective") != "", _cut(F.col("_left"), F.col("_participle")))
        .when(F.col("_verb") != "", _cut(F.col("_plain"), F.col("_verb"))).otherwise(_cut(F.col("_plain"), F.col("_noun")))
    )
    rows = rows.withColumn("_one", F.regexp_replace(first, "и$", ""))
    derived = F.regexp_extract(F.substring("_one", F.col("_r2") + 1, F.length("_one")), pattern(DERIVATIONAL), 0)
    # the longest ending counts, and only if it lies in the second region
    whole = F.regexp_extract("_one", pattern(DERIVATIONAL), 0)
    rows = rows.withColumn("_two", F.when((whole != "") & (derived == whole), _cut(F.col("_one"), whole)).otherwise(F.col("_one")))
    best = F.regexp_replace("_two", pattern(SUPERLATIVE), "")
    last = F.when(F.col("_two").rlike(pattern(SUPERLATIVE)) | F.col("_two").rlike("нн$"), F.regexp_replace(best, "нн$", "н")).otherwise(F.regexp_replace("_two", "ь$", ""))
    stem = F.when(F.col(word).rlike("^[а-яё]+$"), F.concat("_head", last)).otherwise(F.col(word))
    return rows.select(*words.columns, stem.alias("stem"))


def stem_counts(docs: DataFrame, change: Column | None = None) -> DataFrame:
    """stem, n, words of the texts of docs: words are counted first and each distinct one is stemmed once. change: a column of w."""
    counted = docs.select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = stems(counted.select((change if change is not None else F.col("w")).alias("word"), "n"))
    return found.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))

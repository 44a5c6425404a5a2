"""Dictionary lemmas (F2): a form-to-stem map learned from the words themselves.

A word's suffix rules propose stems; those that occur as words of their own are known, and the most
frequent known one is the lemma. So `crashes` becomes `crash` where `crash` is a word, while `this`
or `bus` stay. Words are counted and made distinct before they meet the map, and stems are found by
an equi-join of distinct words, so a frequent word costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (pattern, replacement): inflections of English nouns and verbs. A stem keeps MIN_STEM letters or more.
SUFFIX_RULES = [
    (r"^(.+)ies$", "$1y"),
    (r"^(.+)ied$", "$1y"),
    (r"^(.+(?:s|x|z|ch|sh|o))es$", "$1"),
    (r"^(.+[^siu])s$", "$1"),
    (r"^(.+)ing$", "$1"),
    (r"^(.+)ing$", "$1e"),
    (r"^(.+)ed$", "$1"),
    (r"^(.+)ed$", "$1e"),
    *[(rf"^(.+){c}(?:{c}ing|{c}ed)$", f"$1{c}") for c in "bdgmnpt"],
]
MIN_STEM = 3
MIN_COUNT = 2


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))


def stems(word: Column, rules=None) -> Column:
    """The distinct stems that the rules propose for a word."""
    made = [F.when(word.rlike(p), F.regexp_replace(word, p, r)) for p, r in (rules or SUFFIX_RULES)]
    return F.array_distinct(F.filter(F.array(*made), lambda s: s.isNotNull() & (F.length(s) >= MIN_STEM) & (s != word)))


def learn_lemmas(df: DataFrame, text: str = "text", min_count: int = MIN_COUNT, rules=None) -> DataFrame:
    """(form, lemma, form_count, lemma_count): each word that has a known stem, and the most frequent of
    them (ties: the shorter, then the first by code point). Known: it occurs `min_count` times or more."""
    counts = df.select(F.explode(_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    proposed = counts.select(F.col("word").alias("form"), F.col("n").alias("form_count"), F.explode(stems(F.col("word"), rules)).alias("stem"))
    known = counts.where(F.col("n") >= min_count).select(F.col("word").alias("stem"), F.col("n").alias("stem_count"))
    best = F.max_by(F.struct("stem", "stem_count"), F.struct(F.col("stem_count"), -F.length("stem"), _reversed(F.col("stem"))))
    return (proposed.join(known, "stem").groupBy("form", "form_count").agg(best.alias("b"))
            .select("form", F.col("b.stem").alias("lemma"), "form_count", F.col("b.stem_count").alias("lemma_count")))


def _reversed(word: Column) -> Column:
    """A text that sorts the other way round: letters a to z become z to a."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.concat(F.translate(word, letters, letters[::-1]), F.lit("~"))


def lemmatise(df: DataFrame, key: str, text: str, lemmas: DataFrame, out: str = "lemmatised") -> DataFrame:
    """df with `out`: the space-separated words of `text`, each form replaced by its lemma.

    key must tell rows apart. A row's distinct words meet the map, and what they find comes back as one
    small map for each row; texts are not taken apart for the join."""
    words = df.select(key, F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("form"))
    found = (words.join(lemmas.select("form", "lemma"), "form").groupBy(key)
             .agg(F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_lemmas")))
    swap = F.transform(F.split(F.col(text), " "), lambda w: F.coalesce(F.try_element_at("_lemmas", w), w))
    joined = df.join(found, key, "left")
    return joined.withColumn(out, F.when(F.col("_lemmas").isNull(), F.col(text)).otherwise(F.array_join(swap, " "))).drop("_lemmas")

"""Language gate by learned profiles (F4): which language a text is in, from its letters alone.

A profile is a table of rows (lang, gram, weight): the most frequent padded letter trigrams and short
whole words of a language, weighted by rank. It is learned once from labelled texts; words are
counted before they are cut into grams, so the shuffle carries words, not letters. Detection cuts a
text's words into grams and takes the language whose weights sum to most. The sums of a text come from
its own row alone, in Arrow batches, so neither texts nor grams are shuffled. Weights are whole
numbers, so sums do not depend on their order.

The profile table has languages x size rows, which the driver holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.operators.series import top_per_group

PROFILE_SIZE = 300
#: Words up to so many letters are grams of their own (articles, pronouns, prepositions).
SHORT = 4


def letter_words(text: Column) -> Column:
    """Runs of letters, lower-cased; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def word_grams(word: Column) -> Column:
    """The letter trigrams of a word between underscores, and the whole of a short word."""
    padded = F.concat(F.lit("_"), word, F.lit("_"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(word) <= SHORT, F.concat(grams, F.array(padded))).otherwise(grams)


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, weight): the `size` most frequent grams of each language (ties by gram); the first
    weighs `size`, the last 1. Rows without a language teach nothing."""
    words = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(letter_words(F.col(text))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    grams = counts.select("lang", "n", F.explode(word_grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = top_per_group(grams, "lang", [F.col("n").desc(), F.col("gram").asc()], size)
    return top.select("lang", "gram", (F.lit(size + 1) - F.col("rk")).cast("long").alias("weight"))


def profile_sums(words: Column, profiles: DataFrame) -> tuple[Column, Column]:
    """(the profiles' languages as an array in their order; array<long> of each row's sums, one for each language).

    The profiles, languages x size rows, come to the driver and go to the tasks as one value. Spark's tasks hand the
    words of their rows to Python in Arrow batches; a word that recurs in a batch is cut into grams once."""
    known = profiles.select("lang", "gram", "weight").collect()  # languages x size rows
    langs = sorted({r["lang"] for r in known})
    place = {lang: i for i, lang in enumerate(langs)}
    grams: dict[str, list[tuple[int, int]]] = {}
    for r in known:
        grams.setdefault(r["gram"], []).append((place[r["lang"]], r["weight"]))
    n = len(langs)

    def word_sums(word: str) -> list[int]:
        out = [0] * n
        padded = f"_{word}_"
        for i in range(len(padded) - 2):
            for j, w in grams.get(padded[i:i + 3], ()):
                out[j] += w
        if len(word) <= SHORT:
            for j, w in grams.get(padded, ()):
                out[j] += w
        return out

    @F.arrow_udf("array<long>")
    def sums(column: pa.Array) -> pa.Array:
        flat = column.flatten().dictionary_encode()
        each = np.array([word_sums(w) for w in flat.dictionary.to_pylist()], dtype=np.int64).reshape(len(flat.dictionary), n)
        index = flat.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        out = np.zeros((len(ends), n), dtype=np.int64)
        for j in range(n):  # one language at a time: memory follows the words, not words x languages
            upto = np.append(0, np.cumsum(each[index, j]))[ends]
            out[:, j] = np.diff(upto, prepend=0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * n), pa.array(out.ravel()))

    names = F.array(*[F.lit(x) for x in langs]) if langs else F.array().cast("array<string>")
    return names, sums(words)


def detect_language(df: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """(key, detected, score) of each row; a row whose text meets no profile is left out.

    key must tell rows apart. Ties go to the language that is last by code point."""
    langs, sums = profile_sums(letter_words(F.col(text)), profiles)
    met = df.select(key, sums.alias("_s")).select(key, F.posexplode("_s").alias("_i", "score")).where(F.col("score") > 0)
    scores = met.select(key, F.get(langs, F.col("_i")).alias("lang"), "score").groupBy(key, "lang").agg(F.sum("score").alias("score"))
    return scores.groupBy(key).agg(F.max_by("lang", F.struct("score", "lang")).alias("detected"), F.max("score").alias("score"))


def with_language(df: DataFrame, text: str, profiles: DataFrame, out: str = "lang") -> DataFrame:
    """df with the detected language in `out` (null where none is met)."""
    langs, sums = profile_sums(letter_words(F.col(text)), profiles)
    best = F.array_max(F.zip_with(sums, langs, lambda s, lang: F.struct(s.alias("score"), lang.alias("lang"))))
    found = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out], best.alias("_best"))
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != out],
                        F.when(F.col("_best.score") > 0, F.col("_best.lang")).alias(out))

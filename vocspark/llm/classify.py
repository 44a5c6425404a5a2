"""Operator 13 — quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products.

Features of a text: its words and pairs of neighbouring words, and the runs of one, two and three
word shapes (case, symbols, digits, length class, equal to the word before), which also speak for
words never seen. Each n-gram is hashed into one of `buckets` places; a place's value is log(1 + count),
and the vector has length one. The weight of place 0 is the bias.

Training takes a bounded sample of labelled rows: the labelled ids are thinned by a hash to about
`sample` of them, and of each id one text of at most MAX_BYTES bytes is learned from. The sample is dealt by
hash into shards. In each round every shard runs FTRL over its own documents, from the state that all
share; then the states (z and n of each place) are averaged by Spark, and the driver gets the
averages: at most `buckets` rows, whatever the input. Scoring reads every whole text.

Cases: a null or empty text, or one without words, has no features and scores the bias; without labelled
rows, or with one class only, all weights may be zero (score 0.5) or the bias alone decides. An id that
is labelled twice has the mean label; null labels and those other than 0 and 1 are not learned from.
Repeated rows score alike; of rows that share an id, the one with the smallest md5 is learned from. An
empty table gives an empty table. Columns of docs pass through unless named as a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, unit_hash
from .textarrays import U, Texts, chunks, mixed, window_hashes

BUCKETS = 1 << 18
SAMPLE = 8000
SHARDS = 8
ROUNDS = 4
MAX_BYTES = 1 << 17
#: States are summed as whole numbers of this part, so that the order of the shards does not matter.
FIXED = 2.0 ** 32
RESULTS = {"score": "double"}
_LETTER_CASE = np.zeros(256, dtype=np.uint8)  # 1: A-Z, 2: a-z, 3: digit, 4: other ASCII sign, 0: beyond ASCII
_LETTER_CASE[33:127] = 4
_LETTER_CASE[48:58], _LETTER_CASE[65:91], _LETTER_CASE[97:123] = 3, 1, 2


def shapes(x: Texts, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A number for the look of each word."""
    kind = _LETTER_CASE[x.data]

    def count(k: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind == k)])
        return sums[ends] - sums[starts]

    upper, lower, digits, signs = count(1), count(2), count(3), count(4)
    size = ends - starts
    case = np.select([(upper > 1) & (lower == 0), (upper > 0) & (lower == 0), upper > 0, lower > 0], [1, 2, 3, 4], 0)
    out = case * 4 + np.minimum(signs, 3)
    out = out * 2 + (signs == size)
    out = out * 2 + (digits > 0)
    out = out * 4 + np.digitize(size, [4, 8, 14])
    same = np.zeros(len(words), dtype=np.int64)
    same[1:] = words[1:] == words[:-1]
    same[before[:-1][np.diff(before) > 0]] = 0
    return (out * 2 + same).astype(U)


def features(x: Texts, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each document, places, values) of some texts; places 1 to buckets - 1, ascending."""
    starts, ends, before = x.words()
    words = x.piece_hashes(x.prefix_sums(), starts, ends)
    looks = mixed(shapes(x, words, starts, ends, before) + U(1))
    keys, times = [], []
    for salt, (tokens, width) in enumerate(((words, 1), (words, 2), (looks, 1), (looks, 2), (looks, 3))):
        hashes, _, doc = window_hashes(tokens, before, width)
        place = mixed(hashes ^ U(salt + 1)) % U(buckets - 1) + U(1)
        for parts, own in zip((keys, times), np.unique(doc.astype(U) * U(buckets) + place, return_counts=True), strict=True):
            parts.append(own)
    keys, which = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(which, np.concatenate(times), minlength=len(keys))
    doc, place = (keys // U(buckets)).astype(np.int64), (keys % U(buckets)).astype(np.int32)
    bounds = np.searchsorted(doc, np.arange(x.n + 1))
    values = np.log1p(times)
    norm = np.sqrt(np.bincount(doc, values * values, minlength=x.n))
    return bounds, place, values / norm[doc] if len(doc) else values


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal state: z (gradients, less what the weights account for) and n (their squares)."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        pull = z - np.sign(z) * self.l1
        return np.where(np.abs(z) <= self.l1, 0.0, -pull / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, place: np.ndarray, value: np.ndarray, label: float) -> None:
        """One document: its distinct places, their values, its label."""
        w = self.weights(place)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[place]
        grown = n + g * g
        self.z[place] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[place] = grown


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """At most about `size` rows (doc_id, text, label): one text for each of the sampled ids.

    The ids are chosen among the labels alone, so that only a bounded number of ids is joined with the
    documents, and texts are shuffled of those only."""
    clean = (labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.avg("label").alias("label")))
    share = clean.agg((F.lit(float(size)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("__share"))
    chosen = (clean.withColumn("__u", unit_hash(F.lit("quality"), F.col("doc_id")))
              .join(F.broadcast(share), F.col("__u") < F.col("__share")).select("doc_id", "label"))  # share: one row
    texts = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", "text")
    return (texts.join(F.broadcast(chosen), "doc_id")  # about `size` rows of an id and a number
            .groupBy("doc_id", "label").agg(F.min(F.struct(F.md5("text").alias("h"), "text")).alias("t"))
            .select("doc_id", F.col("t.text").alias("text"), "label"))


def train(rows: DataFrame, buckets: int = BUCKETS, shards: int = SHARDS, rounds: int = ROUNDS, **rates: float) -> np.ndarray:
    """The weights (float64, one for each place) learned from a bounded sample (doc_id, text, label)."""
    dealt = rows.select(F.xxhash64(F.col("doc_id").cast("string")).alias("key"), "text", F.col("label").cast("double").alias("label"),
                        F.floor(unit_hash(F.lit("shard"), F.col("doc_id")) * shards).cast("int").alias("shard"))
    dealt = cut_lineage(dealt)  # a bounded sample, read again in every round
    z, n = np.zeros(buckets), np.zeros(buckets)

    def learn(z: np.ndarray, n: np.ndarray, turn: int):
        def run(group: pa.Table) -> pa.Table:
            state = Ftrl(z.copy(), n.copy(), **rates)
            # every round takes the documents in another order, the same on every rerun
            keys = group.column("key").to_numpy().astype(U)
            order = np.argsort(mixed(keys * U(2 * turn + 1) + U(turn)), kind="stable")
            group = group.take(pa.array(order))
            label = group.column("label").to_numpy()
            for at, x in chunks(group.column("text")):
                bounds, place, value = features(x, buckets)
                for i in range(x.n):
                    own = slice(bounds[i], bounds[i + 1])
                    state.learn(np.append(0, place[own]), np.append(1.0, value[own]), label[at + i])
            used = np.flatnonzero(state.n != n)
            return pa.table({"place": pa.array(used.astype(np.int32)),
                             "z": pa.array(np.rint((state.z[used] - z[used]) * FIXED).astype(np.int64)),
                             "n": pa.array(np.rint((state.n[used] - n[used]) * FIXED).astype(np.int64))})

        return run

    for turn in range(rounds):
        steps = dealt.groupBy("shard").applyInArrow(learn(z, n, turn), "place int, z bigint, n bigint")
        # the mean over the shards that have met the place
        mean = steps.groupBy("place").agg((F.sum("z") / F.count(F.lit(1))).alias("z"),
                                          (F.sum("n") / F.count(F.lit(1))).alias("n")).toArrow()
        at = mean.column("place").to_numpy()
        z[at] += mean.column("z").to_numpy() / FIXED
        n[at] += mean.column("n").to_numpy() / FIXED
    return Ftrl(z, n, **rates).weights(slice(None))


def score(docs: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """The columns `keep` of docs (all by default) and score, the probability of label 1."""

    def run(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for at, x in chunks(columns[0]):
            bounds, place, value = features(x, len(weights))
            doc = np.repeat(np.arange(x.n), np.diff(bounds))
            odds = weights[0] + np.bincount(doc, weights[place] * value, minlength=x.n)
            yield at, x.n, [pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))]

    return map_rows(docs, keep, [docs["text"]], run, RESULTS)


def predicted(score: Column, threshold: float = 0.3) -> Column:
    return F.when(score >= threshold, 1).otherwise(0).cast("int")

"""Operator 7 — language identification by prediction by partial matching (PPM).

Each language has a byte context tree: how often each byte followed each context of up to ORDER
bytes in its training texts. A byte's probability is that of the longest context seen, with an
escape to the next shorter one (method C, with exclusion: what the longer context predicts is taken
out of the shorter one's distribution); below all contexts every byte is equally likely. The
statistics are frozen after training, so a text's code length is the exact sum of -log2 of its
bytes' probabilities, and the language with the shortest code wins. The score is the posterior of
that language, all languages being equally likely before.

Training takes at most `per_lang` documents of each language, those with the smallest hashes of
their ids: a documented bound (a classifier's bounded sample of labelled rows), so that the trees,
and what is broadcast, are bounded by per_lang and the number of languages. Predictions read every
byte of every text.

As the trees are frozen, the code lengths of all (context, byte) pairs are laid out as one table
per worker and texts are scored by array lookups.

Cases: a null text, one without letters, or no training rows gives `und` with score 0; ties go to
the language that is first by code point; repeated rows are scored alike; an empty table gives an
empty table; columns of docs pass through unless named as a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unit_hash
from .textarrays import Texts, chunks

ORDER = 3
PER_LANG = 300


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (a null id is the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """At most per_lang rows (text, lang) of each language, by a hash of doc_id.

    Each language is first thinned by that hash to about twice as many rows as are wanted, so that
    what is ranked, and shuffled with its text, is bounded too."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    draw = unit_hash(F.lit("langid"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    share = rows.groupBy("lang").agg((F.lit(2.0 * per_lang + 50) / F.count(F.lit(1))).alias("__share"))
    thinned = rows.withColumn("__u", draw).join(F.broadcast(share), "lang").where("__u < __share")  # a row for each language
    rank = Window.partitionBy("lang").orderBy("__u", "doc_id", F.xxhash64("text"))
    return thinned.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= per_lang).select("lang", "text")


def _grams(x: Texts, order: int) -> np.ndarray:
    """The last order + 1 bytes up to each byte as one number; before a text's start there are zeros."""
    position = np.arange(len(x.data)) - np.repeat(x.offsets[:-1], np.diff(x.offsets))
    key = np.zeros(len(x.data), dtype=np.int64)
    for k in range(order, 0, -1):
        shifted = np.zeros_like(key)
        shifted[k:] = x.data[:-k] if len(x.data) > k else 0
        shifted[position < k] = 0
        key = (key << 8) | shifted
    return (key << 8) | x.data


@dataclass(frozen=True)
class Counts:
    """For each language, the (order + 1)-grams of its training texts and how often each occurs."""

    langs: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    times: tuple[np.ndarray, ...]
    order: int


def train(rows: DataFrame, order: int = ORDER) -> Counts:
    """Counts the grams of a bounded sample (lang, text) in Spark; the driver gets the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = batch.column(1).filter(pa.array(langs == lang))
                for _, x in chunks(own):
                    grams, times = np.unique(_grams(x, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(times)],
                                                     names=["lang", "gram", "n"])

    counted = (rows.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas())
    langs = tuple(sorted(counted["lang"].unique()))
    parts = [counted[counted["lang"] == lang].sort_values("gram") for lang in langs]
    return Counts(langs, tuple(p["gram"].to_numpy() for p in parts), tuple(p["n"].to_numpy() for p in parts), order)


class Trees:
    """The code lengths (bits) of every symbol in every context, for all languages.

    Bytes that no training text has share symbol 0. `node` leads from the last `order` symbols to the
    longest context seen in any language; a language that has not seen it escapes for free."""

    def __init__(self, counts: Counts):
        order, n_langs = counts.order, len(counts.langs)
        seen = np.zeros(256, dtype=bool)
        for g in counts.grams:
            seen[np.unique(g & 255)] = True
        seen[0] = False
        self.symbol = np.zeros(256, dtype=np.int32)
        self.symbol[seen] = np.arange(1, seen.sum() + 1)
        self.size = a = int(seen.sum()) + 1
        self.order = order
        unseen = 256 - (a - 1)
        grams, n = [], []
        for g, t in zip(counts.grams, counts.times, strict=True):
            s = np.zeros_like(g)
            for k in range(order, -1, -1):
                s = s * a + self.symbol[(g >> (8 * k)) & 255]
            grams.append(s)
            n.append(t)
        uniform = np.full(a, 1 / 256)
        uniform[0] = unseen / 256
        probs = np.broadcast_to(uniform, (1, n_langs, a)).copy()
        self.parent_node = np.zeros(1, dtype=np.int32)
        tables, base = [], 0
        lookup = np.zeros(1, dtype=np.int32)  # node of each context of the order at hand
        for k in range(order + 1):
            keys = [g % a ** (k + 1) for g in grams]
            contexts = np.unique(np.concatenate([x // a for x in keys])) if keys else np.zeros(0, np.int64)
            where = np.full(a ** k, -1, dtype=np.int32)
            where[contexts] = np.arange(len(contexts))
            table = np.zeros((len(contexts), n_langs, a))
            for i, (x, t) in enumerate(zip(keys, n, strict=True)):
                np.add.at(table, (where[x // a], i, x % a), t)
            above = probs[0][None] if k == 0 else probs[lookup[contexts % a ** (k - 1)]]
            own = np.broadcast_to(above, table.shape).copy() if k == 0 else above
            probs_k = _escape(table, own)
            # nodes of this order, then of shorter ones for contexts never seen
            tables.append(probs_k)
            all_nodes = np.where(where >= 0, base + where, -1)
            if k:
                shorter = self._nodes[np.arange(a ** k) % a ** (k - 1)]
                all_nodes = np.where(all_nodes >= 0, all_nodes, shorter)
            self._nodes = all_nodes.astype(np.int32) if len(contexts) else np.zeros(a ** k, np.int32)
            base += len(contexts)
            probs = np.concatenate(tables)
            lookup = self._nodes
        self.node = self._nodes
        bits = -np.log2(probs)
        bits[:, :, 0] += np.log2(unseen)  # one of the bytes that share symbol 0
        self.bits = np.ascontiguousarray(bits.transpose(0, 2, 1)).astype(np.float32).reshape(-1, n_langs)

    def lengths(self, x: Texts) -> np.ndarray:
        """Code length of each text (rows) in each language (columns)."""
        s = self.symbol[x.data]
        position = np.arange(len(s)) - np.repeat(x.offsets[:-1], np.diff(x.offsets))
        context = np.zeros(len(s), dtype=np.int32)
        for k in range(self.order, 0, -1):
            shifted = np.zeros_like(s)
            shifted[k:] = s[:-k] if len(s) > k else 0
            shifted[position < k] = 0
            context = context * self.size + shifted
        costs = self.bits[self.node[context].astype(np.int64) * self.size + s]
        out = np.zeros((x.n, costs.shape[1]))
        full = np.flatnonzero(np.diff(x.offsets))
        if len(full):
            out[full] = np.add.reduceat(costs, x.offsets[full], axis=0, dtype=np.float64)
        return out


def _escape(table: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """PPM method C: counts n over symbols, d of them distinct; seen ones get n / (sum + d), the rest
    share d / (sum + d) by the shorter context's probabilities without the seen symbols."""
    seen = table > 0
    total, distinct = table.sum(axis=2, keepdims=True), seen.sum(axis=2, keepdims=True)
    rest = np.where(seen, 0.0, shorter)
    left = rest.sum(axis=2, keepdims=True)
    escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
    spread = np.where(left > 0, rest / np.where(left > 0, left, 1), 0.0)
    out = np.where(seen, table / np.maximum(total + distinct, 1), escape * spread)
    return np.where((left > 0) | (total == 0), out, table / np.maximum(total, 1))


_trees: dict[int, Trees] = {}


def _worker_trees(handle) -> Trees:
    """Built once for each worker and model."""
    if handle.id not in _trees:
        _trees.clear()
        _trees[handle.id] = Trees(handle.value)
    return _trees[handle.id]


class _Handle:
    """A broadcast of Counts with a number that tells models apart in reused workers."""

    def __init__(self, spark, counts: Counts):
        self.shared = spark.sparkContext.broadcast(counts)
        self.id = hash((spark.sparkContext.applicationId, self.shared._jbroadcast.id()))

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self) -> Counts:
        return self.shared.value


def predict(docs: DataFrame, counts: Counts, *keep: str) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred and score."""
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
                       + ["lang_pred string", "score double"])
    # \\p{L}: any letter
    source = docs.select(*kept, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("__text"))
    handle = _Handle(docs.sparkSession, counts)
    langs = np.array(counts.langs, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text"))
            scored = column.is_valid().to_numpy(zero_copy_only=False) & (len(langs) > 0)
            names, score = np.full(len(column), "und", dtype=object), np.zeros(len(column))
            if scored.any():
                trees = _worker_trees(handle)
                bits = np.concatenate([trees.lengths(x) for _, x in chunks(column)])
                best = bits.argmin(axis=1)
                ahead = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
                names[scored] = langs[best[scored]]
                score[scored] = (1 / ahead.sum(axis=1))[scored]
            own = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                             names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(run, schema)

"""Operator 9 — language-model scoring by a weighted backoff automaton.

The model is a word bigram model over all training documents. Its automaton has a root and a state
for each word seen in training (and one for the start of a text). In state h, a word w that
followed h in training has an arc to state w with weight

    log10((c(h w) + K * p(w)) / (c(h) + K)),    p(w) = (c(w) + 1) / (N + V + 1);

any other word takes the failure arc, log10(K / (c(h) + K)), to the root, whose arcs weigh
log10 p(w). The start of a text is a state whose count is the number of training texts; a word not
seen in training leads back to the root. One pass from left to right carries the state and adds up
the weights; as a state is just the last word, all steps of a block are looked up at once.

Counts come from all training documents and are nowhere capped: blocks of documents send their
distinct words and word pairs (as 64-bit hashes) with their training counts to shards, which add
them up and answer (see `blocks`). Each block holds only the part of the automaton that its own
texts walk through.

Cases: a null text is empty: its only token is the end. Texts of repeated rows count as often as
they occur. Without training documents all counts are 0. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .textarrays import U, Texts, chunks, mixed

PRIOR = 50.0  # K: how many observations the shorter context's estimate weighs
END = mixed(np.array([0x656E64], dtype=U))[0]
START = mixed(np.array([0x7374617274], dtype=U))[0]
_PAIR = U(0xA0761D6478BD642F)


def _tokens(x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then the end, text by text), each token's predecessor's, and
    where each text begins."""
    x = x.lower()
    starts, ends, before = x.words()
    words = x.piece_hashes(x.prefix_sums(), starts, ends)
    first = before[:-1] + np.arange(x.n)
    tokens = np.full(len(words) + x.n, END, dtype=U)
    is_word = np.ones(len(tokens), dtype=bool)
    is_word[before[1:] + np.arange(x.n)] = False
    tokens[is_word] = words
    previous = np.empty_like(tokens)
    previous[1:] = tokens[:-1]
    previous[first] = START
    return tokens, previous, first


def _word_keys(tokens: np.ndarray) -> np.ndarray:
    return tokens & ~U(1)


def _pair_keys(previous: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(previous * _PAIR + tokens) | U(1)


class _Block:
    """A block's tokens in order, and its distinct words and word pairs: `keys`, sorted; `word` and
    `pair` lead from each token to its own and its pair's key, `start` is the key of a text's start."""

    def __init__(self, table: pa.Table):
        words, pairs, sizes = [np.zeros(0, dtype=U)], [np.array([START & ~U(1)], dtype=U)], []
        for _, x in chunks(table.column("text")):
            tokens, previous, first = _tokens(x)
            words.append(_word_keys(tokens))
            pairs.append(_pair_keys(previous, tokens))
            sizes.append(np.diff(np.append(first, len(tokens))))
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        every = np.concatenate(words + pairs)
        n = sum(map(len, words))
        del words, pairs
        order = np.argsort(every)
        every = every[order]
        fresh = np.ones(len(every), dtype=bool)
        fresh[1:] = every[1:] != every[:-1]
        self.keys = every[fresh]
        where = np.empty(len(every), dtype=np.int32)
        where[order] = np.cumsum(fresh, dtype=np.int32) - 1
        self.word, self.start, self.pair = where[:n], where[n], where[n + 1:]

    def counts(self, train: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts that train."""
        taken = np.repeat(train, self.sizes)
        counts = np.bincount(self.word[taken], minlength=len(self.keys)) + np.bincount(self.pair[taken], minlength=len(self.keys))
        counts[self.start] = train.sum()
        return counts


def _totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens and distinct words among these counts; the start is no token."""
    words = (keys & U(1) == 0) & (keys != START & ~U(1))
    return np.array([counts[words].sum(), (counts[words] > 0).sum()], dtype=np.int64)


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, train: Column, prior: float = PRIOR, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id and train (boolean, as given) with RESULTS, all scores in log10."""
    n = B.n_blocks(docs, block_bytes)
    rows = B.blocked(docs.withColumn("train", F.coalesce(train, F.lit(False))), n, "doc_id", "train")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def send(table: pa.Table) -> pa.Table:
        number, block = table.column("__block")[0].as_py(), _Block(table)
        keys, counts = block.keys, block.counts(table.column("train").to_numpy(zero_copy_only=False).astype(bool))
        at = B.shard_bounds(keys, n)
        return B.messages([(number, s, 0, B.pack(B.gaps(keys[at[s]: at[s + 1]]), B.narrow(counts[at[s]: at[s + 1]])))
                           for s in range(n)])

    def merge(table: pa.Table) -> pa.Table:
        sent = [(b, s, *B.unpack(body)) for b, s, body in B.read_messages(table)]
        keys = [B.ungaps(k) for _, _, k, _ in sent]
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(where, np.concatenate([c for *_, c in sent]), len(every)).astype(np.int64)
        totals = _totals(every, counts)
        ends = np.cumsum([len(k) for k in keys])
        return B.messages([(b, s, 0, B.pack(B.narrow(counts[where[e - len(k): e]]), totals))
                           for (b, s, *_), k, e in zip(sent, keys, ends, strict=True)])

    def walk(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = [B.unpack(body) for _, _, body in B.read_messages(answers)]
        counts = np.concatenate([c.astype(np.int64) for c, _ in own]) if own else np.zeros(0, np.int64)
        total, types = np.sum([t for _, t in own], axis=0) if own else (0, 0)
        if len(texts):
            block = _Block(texts)
            first = block.first
            count, pair = counts[block.word], counts[block.pair]
            state = np.empty_like(count)  # of the token before; 0: the root
            state[1:] = count[:-1]
            state[first] = counts[block.start]
            root = np.log10((count + 1) / (total + types + 1))
            known = np.add.reduceat((count > 0).astype(np.int64), first)
            arc = np.log10((pair + prior * (count + 1) / (total + types + 1)) / (state + prior))
            weight = np.where(pair > 0, arc, root + np.log10(prior / (state + prior)))
            columns = [block.sizes, known, np.full(len(first), total), np.add.reduceat(root, first), np.add.reduceat(weight, first)]
        else:
            columns = [np.zeros(0)] * 5
        types_out = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.table([texts.column("doc_id"), texts.column("train"), *[pa.array(c, t) for c, t in zip(columns, types_out, strict=True)]],
                        names=["doc_id", "train", *RESULTS])

    sent = rows.groupBy("__block").applyInArrow(send, B.MESSAGE)
    answers = sent.groupBy("shard").applyInArrow(merge, B.MESSAGE)
    schema = (f"doc_id {id_type}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")
    return rows.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(walk, schema)

"""Operator 6 — quality rules by weak supervision.

Each rule votes bad, abstains or votes good on a document, from counts over its whole text.
Expectation-maximisation over the counts of vote patterns estimates, for both classes, how often
each rule casts each vote (its accuracy), and the share of good documents. The posterior
probability of being good then decides, instead of an all-must-pass filter.

The votes are aggregated by pattern in Spark; with R rules there are at most 3**R patterns, so what
the driver gets is bounded however many documents there are. The fitted model is a number for each
rule and vote; applying it is a native expression.

Cases: a null or empty text has no words and fails the base rules; all rules abstain on it. Repeated
rows are judged alike. An empty table gives an empty table. Columns of docs pass through `judge`
unless they have the name of one that it adds; those are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import SPACE, U, Texts, chunks, mixed, window_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_bangs", "n_upper", "n_lower")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count(x: Texts) -> np.ndarray:
    """One row for each of COUNTS, one column for each document."""
    starts, ends, before = x.words()
    sums = x.prefix_sums()
    words = x.piece_hashes(sums, starts, ends)
    solid = ~SPACE[x.data]
    line_start, line_end, line_doc = x.lines()
    solid_sums = np.concatenate([[0], np.cumsum(solid)])
    full = solid_sums[line_end] > solid_sums[line_start]
    line_doc = line_doc[full]
    keys = mixed(x.piece_hashes(sums, line_start, line_end)[full] + mixed(line_doc.astype(U)))
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(line_doc, minlength=x.n)
    repeated_lines = lines - np.bincount(line_doc[first], minlength=x.n)

    hashes, at, doc = window_hashes(words, before, 3)
    _, where, times = np.unique(mixed(hashes + mixed(doc.astype(U))), return_inverse=True, return_counts=True)
    at = at[times[where] > 1]
    marked = np.zeros(len(words) + 3, dtype=bool)
    for k in range(3):
        marked[at + k] = True
    marks = np.concatenate([[0], np.cumsum(marked[: len(words)])])
    return np.stack([
        np.diff(before), x.per_doc(solid & ((x.data & 0xC0) != 0x80)), x.per_doc(_SYMBOL[x.data]), repeated_lines,
        marks[before[1:]] - marks[before[:-1]], lines, x.per_doc(x.data == 33),
        x.per_doc((x.data >= 65) & (x.data <= 90)), x.per_doc((x.data >= 97) & (x.data <= 122))]).astype(np.int64)


def with_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of docs (all by default) and COUNTS."""
    keep = [c for c in (keep or docs.columns) if c not in COUNTS]
    source = docs.select(*keep, *(() if "text" in keep else ("text",)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
                       + [f"{c} bigint" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count(x) for _, x in chunks(batch.column(batch.schema.get_field_index("text")))]
            values = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(v) for v in values], names=[*keep, *COUNTS])

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where its condition (SQL over COUNTS) holds, and abstains otherwise.
    Without words it always abstains."""

    name: str
    bad: str = "false"
    good: str = "false"

    def vote(self) -> Column:
        return (F.when(F.col("n_words") == 0, 1).when(F.expr(self.bad), 0).when(F.expr(self.good), 2)
                .otherwise(1)).cast("int")


#: Most rules know a kind of junk and have no opinion on the rest; `prose` and `varied` can vouch for a text.
RULES = (
    Rule("symbols", bad="n_symbols > 0.1 * n_words"),
    Rule("shouting", bad="n_bangs > 0.1 * n_words"),
    Rule("capitals", bad="n_upper > 0.5 * (n_upper + n_lower + 1)"),
    Rule("lines", bad="n_dup_lines > 0.4 * n_lines"),
    Rule("varied", bad="n_repeat_words > 0.35 * n_words", good="n_repeat_words < 0.2 * n_words"),
    Rule("prose", bad="word_chars < 2.5 * n_words or word_chars > 12 * n_words",
         good="n_symbols + n_bangs < 0.05 * n_words and word_chars between 3.5 * n_words and 8 * n_words"),
)
SMOOTHING = 0.01
ROUNDS = 200


@dataclass(frozen=True)
class Model:
    """prior: log odds of good; weights[rule][vote]: what a vote (bad, none, good) adds to them."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(self.prior)
        for vote, w in zip(votes, self.weights, strict=True):
            odds = odds + F.when(vote == 0, w[0]).when(vote == 2, w[2]).otherwise(w[1])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(patterns: np.ndarray, counts: np.ndarray) -> Model:
    """EM over vote patterns (rows of 0, 1, 2). It begins from the belief that a document with any
    bad vote is probably bad; abstaining says the same of either class at first."""
    n_rules = patterns.shape[1]
    if not len(patterns):
        return Model(0.0, ((0.0, 0.0, 0.0),) * n_rules)
    cast = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    good = np.where((patterns == 0).any(axis=1), 0.1, np.where((patterns == 2).any(axis=1), 0.95, 0.5))
    prior, weights = 0.0, np.zeros((n_rules, 3))
    for _ in range(ROUNDS):
        tables = []
        for p in (good, 1 - good):
            t = np.einsum("n,nrv->rv", p * counts, cast) + SMOOTHING
            tables.append(t / t.sum(axis=1, keepdims=True))
        share = ((good * counts).sum() + SMOOTHING) / (counts.sum() + 2 * SMOOTHING)
        prior, weights = float(np.log(share / (1 - share))), np.log(tables[0] / tables[1])
        odds = np.clip(prior + np.einsum("nrv,rv->n", cast, weights), -500, 500)
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - good).max() < 1e-12:
            break
        good = new
    return Model(prior, tuple(tuple(map(float, w)) for w in weights))


def fit(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Estimates the rules' accuracies over all rows of a table with COUNTS."""
    names = [f"__v{i}" for i in range(len(rules))]
    rows = (counted.select(*[r.vote().alias(n) for r, n in zip(rules, names, strict=True)])
            .groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect())  # at most 3 ** len(rules)
    votes = np.array([[r[n] for n in names] for r in rows]).reshape(len(rows), len(names))
    return estimate(votes, np.array([r["n"] for r in rows], dtype=float))


MIN_WORDS = 50


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judge(counted: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, p_good (posterior) and kept."""
    out = counted.withColumn("base_failed", base_failed())
    out = out.withColumn("p_good", model.posterior([r.vote() for r in rules]))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))

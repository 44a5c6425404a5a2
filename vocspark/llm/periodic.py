"""Operator 11 — periodic run detection by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at
least max(min_length, min_repeats * q) words, that no neighbouring word extends keeping that period.

Each word of such a run occurs at least min_repeats times in it. So a word that occurs fewer times
within its segment (at first the whole text) belongs to no run: it splits the segment. The parts are
counted again, until no word goes; parts below min_length words go too. In prose little survives.

The surviving segments are scanned lag by lag. A run with period p holds min_repeats - 1 whole blocks
of p words that begin at multiples of p in the segment, and they are all equal. Comparing the hashes
of neighbouring blocks takes n / p steps for lag p, so n log n for all lags of a segment, and
nominates places; each is then compared word by word, which gives its exact ends. A place inside a
run of a smaller period is a repetition of that run and no run of its own, so it is skipped.

All of it works within a document: rows are mapped, nothing is shuffled. A task holds one Arrow batch
and the word arrays of about 1 MB of texts, or of one longer text.

Cases: a null or empty text, or one of white space only, has no words, no runs and an empty collapsed
text; repeated rows give equal results; an empty table gives an empty table; columns of docs pass
through unless they have the name of a result, which replaces them. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_rows
from .textarrays import U, Texts, chunks

MIN_LENGTH = 6
MIN_REPEATS = 4
#: After so many rounds of splitting a segment goes to the scan, which is exact on any segment. It only
#: bounds the time of texts made to lose a few words a round.
ROUNDS = 64
RESULTS = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}
_BASE = U(0x9E3779B97F4A7C15)


def split(words: np.ndarray, before: np.ndarray, min_length: int, min_repeats: int,
          rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments that frequency splitting leaves. words: one number for each
    word; before: the number of words before each document."""
    starts, ends = [], []
    at = np.arange(len(words))
    seg = np.repeat(np.arange(len(before) - 1), np.diff(before))
    _, word = np.unique(words, return_inverse=True)
    n_words = int(word.max()) + 1 if len(word) else 0
    for turn in range(rounds):
        if not len(at):
            break
        _, pair, times = np.unique(seg * n_words + word[at], return_inverse=True, return_counts=True)
        keep = times[pair] >= min_repeats
        unstable = np.zeros(int(seg.max()) + 1, dtype=bool)
        unstable[seg[~keep]] = True
        at, seg = at[keep], seg[keep]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(seg) != 0)
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(at)))
        again = unstable[seg[first]]
        long = size >= min_length
        done = long & (~again if turn < rounds - 1 else True)
        starts.append(at[first[done]])
        ends.append(at[first[done]] + size[done])
        go = long & again
        part = np.cumsum(fresh) - 1
        stays = go[part]
        at, seg = at[stays], (np.cumsum(go) - 1)[part[stays]]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def _stretches(w: np.ndarray, a: int, b: int, p: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the longest stretches of w[a:b] with words p apart equal, of least words or more."""
    same = np.concatenate([[False], w[a:b - p] == w[a + p:b], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    return [(a + int(s), int(e - s) + p) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s + p >= least]


def scan(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int, min_repeats: int) -> np.ndarray:
    """(start, length, period) of every run within the segments, by start and period."""
    sizes = ends - starts
    found: list[tuple[int, int, int]] = []
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    with np.errstate(over="ignore"):
        lags = int(sizes.max()) // min_repeats
        power = np.concatenate([[U(1)], np.full(lags, _BASE, dtype=U)]).cumprod(dtype=U)
        weights = np.full(len(words), _BASE, dtype=U).cumprod(dtype=U)
        sums = np.concatenate([[U(0)], np.cumsum(words * weights, dtype=U)])
        until = np.zeros(len(words), dtype=np.int64)  # the farthest end of a run found over each word
        low = 1
        while low <= lags:
            live = np.flatnonzero((sizes >= min_repeats * low) & (sizes >= min_length))
            n_lags = np.minimum(2 * low - 1, sizes[live] // min_repeats) - low + 1
            seg = np.repeat(live, n_lags)
            p = low + np.arange(len(seg)) - np.repeat(np.cumsum(n_lags) - n_lags, n_lags)
            n_pairs = sizes[seg] // p - 1
            pair = np.repeat(np.arange(len(seg)), n_pairs)
            step = p[pair]
            left = starts[seg][pair] + step * (np.arange(len(pair)) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs))
            middle = sums[left + step]
            equal = np.flatnonzero((middle - sums[left]) * power[step] == sums[left + 2 * step] - middle)
            if len(equal):
                fresh = np.ones(len(equal), dtype=bool)
                fresh[1:] = (np.diff(equal) != 1) | (np.diff(pair[equal]) != 0)
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(equal)) - 1
                enough = last - first + 1 >= min_repeats - 2
                s, e = left[equal[first[enough]]], left[equal[last[enough]]] + 2 * step[equal[last[enough]]]
                owner = pair[equal[first[enough]]]
                open_ = until[s] < e
                for a, b, o in zip(s[open_].tolist(), e[open_].tolist(), owner[open_].tolist(), strict=True):
                    if until[a] >= b:
                        continue
                    lag, g = int(p[o]), seg[o]
                    for at, size in _stretches(words, max(int(starts[g]), a - lag), min(int(ends[g]), b + lag), lag,
                                               max(min_length, min_repeats * lag)):
                        if until[at] < at + size:
                            found.append((at, size, lag))
                            np.maximum(until[at:at + size], at + size, out=until[at:at + size])
            low *= 2
    out = np.array(found, dtype=np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(x: Texts, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS, rounds: int = ROUNDS):
    """(word starts, word ends, words before each document, runs) of some texts."""
    begin, end, before = x.words()
    words = x.piece_hashes(x.prefix_sums(), begin, end)
    starts, ends = split(words, before, min_length, min_repeats, rounds)
    return begin, end, before, scan(words, starts, ends, min_length, min_repeats)


def _collapsed(x: Texts, begin: np.ndarray, end: np.ndarray, before: np.ndarray, runs: np.ndarray) -> pa.Array:
    """The words that no run holds after its first period, joined by one space, of each document."""
    marks = np.zeros(len(begin) + 1, dtype=np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    sizes = end[kept] - begin[kept] + 1  # with a space after each
    to = np.cumsum(sizes)
    source = np.repeat(begin[kept] - (to - sizes), sizes) + np.arange(int(to[-1]) if len(to) else 0)
    data = np.append(x.data, np.uint8(32))[np.minimum(source, len(x.data))]
    data[to - 1] = 32
    n_kept = np.searchsorted(kept, before)
    bounds = np.append(0, to)[n_kept]
    last = to[n_kept[1:][np.diff(n_kept) > 0] - 1] - 1  # the spaces after the last words go
    solid = np.ones(len(data), dtype=bool)
    solid[last] = False
    offsets = bounds - np.append(0, np.cumsum(np.diff(n_kept) > 0))
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), x.n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[solid])]).cast(pa.large_string())


def with_runs(docs: DataFrame, *keep: str, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """The columns `keep` of docs (all by default), n_words, runs (start, length and period in words, by
    start and period) and collapsed (the words that are left when each run keeps its first period)."""
    if min_repeats < 3 or min_length < min_repeats:
        raise ValueError("min_repeats is 3 at least, and min_length is no less")

    def run(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for at, x in chunks(columns[0]):
            begin, end, before, runs = runs_of(x, min_length, min_repeats)
            doc = np.searchsorted(before, runs[:, 0], side="right") - 1
            own = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0] - before[doc]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(x.n + 1)).astype(np.int32)), own)
            yield at, x.n, [pa.array(np.diff(before)), lists, _collapsed(x, begin, end, before, runs).cast(pa.string())]

    return map_rows(docs, keep, [docs["text"]], run, RESULTS)


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period) as a struct of less (its length,
    negated), start and period; null without runs."""
    return F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))


def with_planted_tail(docs: DataFrame, share: int = 10) -> DataFrame:
    """Replaces the text of one document in `share`, by the crc32 h of its id: with g = h / share, the
    words from a = g % n on repeat the p = 1 + (n - a) / (3 + g % 8) words that begin at a. Other
    texts, those without words and rows without id stay as they are."""
    row = docs.select(F.struct("*").alias("row"))
    h = F.crc32(F.col("row.doc_id").cast("string").cast("binary"))
    # null unless chosen: the words of other texts are never taken apart
    words = F.when(h % share == 0, F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)))
    n = F.size("words").cast("long")
    row = row.withColumn("g", F.floor(h / share)).withColumn("words", words)
    row = row.withColumn("a", F.when(n > 0, F.col("g") % F.nullif(n, F.lit(0))))
    row = row.withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at("words", (
        F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int")))
    text = F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("row.text"))
    return row.select(F.col("row").withField("text", text).alias("row")).select("row.*")

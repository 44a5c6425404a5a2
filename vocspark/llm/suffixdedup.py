"""Operator 1 — removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller
id; strings are judged on the input. The suffixes that share such a prefix are found as in the
difference-cover algorithm: a sample of positions stands for all, sampled pieces are sorted and
named, only what the names leave open is sorted further by recursion, the remaining suffixes are
merged in through the sampled ones, and neighbours in the order are compared.

1. Sample. In every window of `length` bytes the gram with the smallest hash is the window's
   anchor. Equal windows have equal anchors at equal places, so anchors are a cover that any two
   equal strings share, as a difference cover's residues are, at a fourteenth of all positions.
   Blocks send their anchors' grams to shards; grams that occur once in all documents are done.
2. Names. For every other anchor, the stretch of windows that it stands for goes to the gram's
   shard, once per block and content. Equal stretches get one name and their smallest id. A gram
   with a single stretch is done: all its windows have that smallest id.
3. Recursion and merge. Stretches that share a gram but differ are joined to one text per shard and
   suffix-sorted: triples at positions 1 and 2 mod 3 are named by sorting, the names' own triples
   sorted by recursion until they cover `length` bytes, and positions 0 mod 3 merged through the
   ranks that follow them. Neighbours with equal `length` bytes form a class; its smallest id
   answers for each window, and blocks cut their texts accordingly.

Messages hold each distinct gram or stretch once per block, so a passage or a copied text that a
third of all documents hold weighs as much as the number of blocks. Stretches at the border of such
a passage differ in every document; the windows of an anchor with over HOT occurrences therefore
travel one by one to the shards of their own hashes. Both ways give the same result.

Cases: a null text is empty; texts shorter than `length` are kept; a null doc_id counts as larger
than any other; rows with equal ids do not cover each other; an empty table gives an empty table;
columns of docs pass through unless named as a result. Grams and stretches are told apart by
64-bit hashes within one shard and gram; classes of the suffix sort by the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .textarrays import U, Texts, chunks, distinct

LENGTH = 50
GRAM = 24
HOT = 10_000
CHUNK = 1 << 18
BLOCK_BYTES = 8 << 20
SHARDS_PER_BLOCK = 4
SLICE = 1 << 18  # bytes that a shard suffix-sorts at a time, but whole grams
_POSITION = U((1 << 32) - 1)
_LAST = np.iinfo(np.int64).max


# --- the suffix sort ---------------------------------------------------------------------------

def _ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1; equal keys rank alike."""
    order = np.argsort(keys)
    step = np.empty(len(keys), dtype=np.int64)
    if len(keys):
        ordered = keys[order]
        step[0] = 1
        step[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


def _joined(*columns: np.ndarray) -> np.ndarray:
    """One order-preserving number for each row of non-negative columns."""
    key = columns[0]
    for c in columns[1:]:
        bits = int(c.max()).bit_length() if len(c) else 0
        if (int(key.max()).bit_length() if len(key) else 0) + bits > 62:
            key = _ranked(key)
        key = (key << bits) | c
    return key


def suffix_ranks(names: np.ndarray, covers: int, need: int) -> np.ndarray:
    """A number for each position, smaller for smaller suffixes. Each name (from 1) covers `covers`
    bytes; suffixes with equal first `need` bytes are neighbours in the order, in no defined order."""
    n = len(names)
    s = np.concatenate([names, np.zeros(4, dtype=np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    triples = _ranked(_joined(s[sampled], s[sampled + 1], s[sampled + 2]))
    if len(triples) and 3 * covers < need and triples.max() < len(triples):
        triples = suffix_ranks(triples, 3 * covers, need) + 1
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sampled] = triples
    zero, one = np.arange(0, n, 3), one[one < n]
    # zeros against ones by (name, rank of the rest), against twos by (name, name, rank of the rest)
    both = np.concatenate([zero, one])
    zero_one, one_keys = np.split(_joined(s[both], rank[both + 1]), [len(zero)])
    both = np.concatenate([zero, two])
    zero_two, two_keys = np.split(_joined(s[both], s[both + 1], rank[both + 2]), [len(zero)])
    out = np.empty(n, dtype=np.int64)
    in_order = np.sort(rank[np.concatenate([one, two])])
    below_zero = np.zeros(len(zero), dtype=np.int64)
    zeros = np.argsort(zero_one)
    for places, keys, zero_keys in ((one, one_keys, zero_one[zeros]), (two, two_keys, zero_two[zeros])):
        order = np.argsort(rank[places])  # searching in order keeps to the caches
        keys, places = keys[order], places[order]
        out[places] = np.searchsorted(in_order, rank[places]) + np.searchsorted(np.sort(zero_keys), keys)
        below_zero += np.searchsorted(np.sort(keys), zero_keys)
    out[zero[zeros]] = np.searchsorted(zero_one[zeros], zero_one[zeros]) + below_zero
    return out


def prefix_classes(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """places in suffix order, and where each class of equal `length` bytes begins in that order."""
    rank = suffix_ranks(np.concatenate([data.astype(np.int64) + 1, np.ones(length, dtype=np.int64)]), 1, length)
    order = places[np.argsort(rank[places], kind="stable")]
    fresh = np.ones(len(order), dtype=bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    for at in range(1, len(order), 1 << 16):
        to = min(len(order), at + (1 << 16))
        fresh[at:to] = (view[order[at:to]] != view[order[at - 1: to - 1]]).any(axis=1)
    return order, np.flatnonzero(fresh)


# --- anchors and stretches of one block ----------------------------------------------------------

def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size:]) if size < width else a


class Anchored:
    """The anchors of some texts: gram hash, first window and number of windows, document."""

    def __init__(self, x: Texts, length: int, gram: int):
        self.x, self.length = x, length
        self.sums = x.prefix_sums()
        if len(x.data) < length:
            self.keys = np.zeros(0, dtype=U)
            self.first = self.count = self.doc = np.zeros(0, dtype=np.int64)
            return
        grams = x.gram_hashes(self.sums, gram)
        place = np.arange(len(grams), dtype=U)
        least = _sliding_min((grams & ~_POSITION) | place, length - gram + 1)
        anchor = (least & _POSITION).astype(np.int64)
        doc = np.repeat(np.arange(x.n), np.diff(x.offsets))
        inside = doc[: len(anchor)] == doc[length - 1:]
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        self.first = np.flatnonzero(new)
        ended = inside.copy()
        ended[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
        self.count = np.flatnonzero(ended) - self.first + 1
        self.keys = grams[anchor[self.first]]
        self.doc = doc[self.first]

    def stretches(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, first, count, document) of the anchors flagged 1, and of each window of those flagged 2."""
        whole, hot = flags == 1, flags == 2
        count = self.count[hot]
        single = np.repeat(self.first[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return (np.concatenate([self.keys[whole], self.x.piece_hashes(self.sums, single, single + self.length)]),
                np.concatenate([self.first[whole], single]),
                np.concatenate([self.count[whole], np.ones(len(single), dtype=np.int64)]),
                np.concatenate([self.doc[whole], np.repeat(self.doc[hot], count)]))

    def names(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A hash of each stretch's bytes."""
        return self.x.piece_hashes(self.sums, first, first + count + (self.length - 1))


def _pieces(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of some pieces, one after another."""
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return data[at]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy()


class _Block:
    """One block's texts with their anchors, chunk by chunk, and its sorted distinct grams."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.ids = _ids(table)
        self.length, self.gram = length, gram
        self.column = table.column("text")

    def parts(self):
        for at, x in chunks(self.column, CHUNK):
            yield at, Anchored(x, self.length, self.gram)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        every = [a.keys for _, a in self.parts()]
        return np.unique(np.concatenate(every) if every else np.zeros(0, dtype=U), return_counts=True)


def _flags(grams: np.ndarray, answers: list[bytes]) -> np.ndarray:
    return np.concatenate([B.unpack(b)[0] for b in answers]) if answers else np.zeros(len(grams), np.uint8)


def _stretch_table(block: _Block, answers: list[bytes]):
    """The block's distinct stretches, sorted by (key, name): keys, names, counts, smallest ids, a
    text with each one's bytes; and, for each part, its occurrences with their stretch's index."""
    occurrences = []
    parts = list(block.parts())
    every = [a.keys for _, a in parts]
    grams = distinct(np.concatenate(every) if every else np.zeros(0, dtype=U))
    flags = _flags(grams, answers)
    for at, a in parts:
        key, first, count, doc = a.stretches(flags[np.searchsorted(grams, a.keys)])
        name = a.names(first, count)
        occurrences.append((at, a.x, first, count, doc, key, name))
    if not occurrences:
        return [], None
    key, name = (np.concatenate([o[k] for o in occurrences]) for k in (5, 6))
    ids = np.concatenate([block.ids[at + doc] for at, _, _, _, doc, _, _ in occurrences])
    order = np.lexsort((ids, name, key))
    key, name, ids = key[order], name[order], ids[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    index = np.empty(len(order), dtype=np.int64)
    index[order] = np.cumsum(fresh) - 1
    lead = order[fresh]  # the occurrence with the smallest id
    ends = np.cumsum([len(o[2]) for o in occurrences])
    out = []
    sizes, texts = np.zeros(len(lead), dtype=np.int64), [None] * len(occurrences)
    for k, (at, x, first, count, doc, _, _) in enumerate(occurrences):
        begin = ends[k] - len(first)
        own = (lead >= begin) & (lead < ends[k])
        sizes[own] = count[lead[own] - begin]
        texts[k] = (np.flatnonzero(own), _pieces(x.data, first[lead[own] - begin], count[lead[own] - begin] + (block.length - 1)))
        out.append((at, x, first, count, doc, index[begin: ends[k]]))
    bytes_of = sizes + (block.length - 1)
    starts = np.cumsum(bytes_of) - bytes_of
    data = np.empty(bytes_of.sum(), dtype=np.uint8)
    for where, pieces in texts:
        n = bytes_of[where]
        data[np.repeat(starts[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = pieces
    return out, (key[fresh], name[fresh], sizes, ids[fresh], starts, data)


# --- the operator --------------------------------------------------------------------------------

def _send_grams(shards: int, length: int, gram: int):
    def send(table: pa.Table) -> pa.Table:
        grams, times = _Block(table, length, gram).grams()
        at = B.shard_bounds(grams, shards)
        block = table.column("__block")[0].as_py()
        return B.messages([(block, s, 0, B.pack(B.gaps(grams[at[s]: at[s + 1]]), B.narrow(times[at[s]: at[s + 1]])))
                           for s in range(shards)])
    return send


def _mark_grams(hot: int):
    def mark(table: pa.Table) -> pa.Table:
        sent = [(b, s, *B.unpack(body)) for b, s, body in B.read_messages(table)]
        grams = [B.ungaps(g) for _, _, g, _ in sent]
        every, where = np.unique(np.concatenate(grams), return_inverse=True)
        times = np.bincount(where, np.concatenate([t for *_, t in sent]), len(every))
        flags = np.where(times > hot, 2, np.where(times > 1, 1, 0)).astype(np.uint8)
        ends = np.cumsum([len(g) for g in grams])
        return B.messages([(b, s, 0, B.pack(flags[where[e - len(g): e]])) for (b, s, *_), g, e in zip(sent, grams, ends, strict=True)])
    return mark


def _send_stretches(shards: int, length: int, gram: int):
    def send(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return B.messages([])
        marks = [body for _, _, body in B.read_messages(answers, 0)]
        _, table = _stretch_table(_Block(texts, length, gram), marks)
        if table is None:
            return B.messages([])
        keys, names, sizes, ids, starts, data = table
        at = B.shard_bounds(keys, shards)
        ends = np.append(starts, len(data))
        block = texts.column("__block")[0].as_py()
        return B.messages([(block, s, 1, B.pack(keys[at[s]: at[s + 1]], names[at[s]: at[s + 1]], B.narrow(sizes[at[s]: at[s + 1]]),
                                                ids[at[s]: at[s + 1]], data[ends[at[s]]: ends[at[s + 1]]]))
                           for s in range(shards) if at[s] < at[s + 1]])
    return send


def _least_ids(keys, names, sizes, ids, data, length: int):
    """For distinct stretches sorted by (key, name): each window's smallest id, stretch by stretch."""
    windows = np.repeat(ids, sizes)
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(fresh) - 1
    open_ = np.bincount(group)[group] > 1
    which = np.flatnonzero(open_)
    spans = sizes + (length - 1)
    starts = np.cumsum(spans) - spans
    at_window = np.cumsum(sizes) - sizes
    # grams are independent of each other: sort the texts of some at a time
    before = np.cumsum(spans[which]) - spans[which]
    lead = np.concatenate([[True], group[which][1:] != group[which][:-1]]) if len(which) else np.zeros(0, bool)
    slices = np.maximum.accumulate(np.where(lead, before // SLICE, 0)) if len(which) else before
    for part in np.split(which, np.flatnonzero(np.diff(slices)) + 1):
        if not len(part):
            continue
        own, n = spans[part], sizes[part]
        text = _pieces(data, starts[part], own)
        begins = np.cumsum(own) - own
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = np.repeat(begins, n) + inner
        least = np.repeat(ids[part], n)
        slot = np.empty(len(text), dtype=np.int64)
        slot[places] = np.arange(len(places))
        order, begin = prefix_classes(text, places, length)
        ordered = slot[order]
        smallest = np.minimum.reduceat(least[ordered], begin)
        least[ordered] = np.repeat(smallest, np.diff(np.append(begin, len(order))))
        windows[np.repeat(at_window[part], n) + inner] = least
    return windows


def _resolve(length: int):
    def resolve(table: pa.Table) -> pa.Table:
        sent = [(b, s, *B.unpack(body)) for b, s, body in B.read_messages(table)]
        keys, names, ids = (np.concatenate([m[k] for m in sent]) for k in (2, 3, 5))
        sizes = np.concatenate([m[4] for m in sent]).astype(np.int64)
        data = np.concatenate([m[6] for m in sent])
        order = np.lexsort((ids, names, keys))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (names[order][1:] != names[order][:-1])
        index = np.empty(len(order), dtype=np.int64)
        index[order] = np.cumsum(fresh) - 1
        lead = order[fresh]
        spans = sizes + (length - 1)
        starts = np.cumsum(spans) - spans
        pieces = _pieces(data, starts[lead], spans[lead])
        del data
        windows = _least_ids(keys[lead], names[lead], sizes[lead], ids[lead], pieces, length)
        begins = np.cumsum(sizes[lead]) - sizes[lead]
        ends = np.cumsum([len(m[2]) for m in sent])
        out = []
        for (b, s, k, *_), end in zip(sent, ends, strict=True):
            own = index[end - len(k): end]
            n = sizes[lead][own]
            least = windows[np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            runs = np.ones(len(least), dtype=bool)
            runs[1:] = least[1:] != least[:-1]
            out.append((b, s, 1, B.pack(B.narrow(np.diff(np.append(np.flatnonzero(runs), len(least)))), least[runs])))
        return B.messages(out)
    return resolve


def _cut(length: int, gram: int, kept: list[str], as_text: bool):
    def cut(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(texts, length, gram)
        occurrences, table = _stretch_table(block, [b for _, _, b in B.read_messages(answers, 0)]) if len(texts) else ([], None)
        runs = [B.unpack(b) for _, _, b in B.read_messages(answers, 1)]
        least = (np.repeat(np.concatenate([r[1] for r in runs]), np.concatenate([r[0].astype(np.int64) for r in runs]))
                 if runs else np.zeros(0, np.int64))
        kept_bytes: list[bytes] = []
        spans: list[list[dict]] = []
        for at, x, first, count, doc, index in occurrences:
            begins = np.cumsum(table[2]) - table[2]
            own = np.repeat(begins[index] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = place[least[own] < np.repeat(block.ids[at + doc], count)]
            change = np.zeros(len(x.data) + 1, dtype=np.int32)
            np.add.at(change, place, 1)
            np.add.at(change, place + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            for d in range(x.n):
                lo, hi = x.offsets[d], x.offsets[d + 1]
                own_gone = gone[lo:hi]
                if not len(place) or not own_gone.any():
                    kept_bytes.append(x.data[lo:hi].tobytes())
                    spans.append([])
                    continue
                steps = np.flatnonzero(np.diff(np.concatenate([[0], own_gone.view(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in steps.reshape(-1, 2)])
                kept_bytes.append(x.data[lo:hi][~own_gone].tobytes())
        columns = [texts.column(c) for c in kept]
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        rest = (pa.array([b.decode("utf-8", errors="ignore") for b in kept_bytes], pa.string()) if as_text
                else pa.array(kept_bytes, pa.binary()))
        return pa.table([*columns, pa.array(spans, span_type), rest], names=[*kept, "removed", "kept"])
    return cut


def remove_repeats(docs: DataFrame, *keep: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                   block_bytes: int = BLOCK_BYTES, as_text: bool = False) -> DataFrame:
    """The columns `keep` of docs (all by default) with `removed` (spans of bytes, maximal, in
    order) and `kept`: the remaining bytes, or as text, without characters that a cut has split."""
    columns = [c for c in (keep or docs.columns) if c not in ("removed", "kept", "__block")]
    n = B.n_blocks(docs, block_bytes)
    shards = SHARDS_PER_BLOCK * n
    rows = B.blocked(docs, n, *dict.fromkeys([*columns, "doc_id"]))
    by_block = rows.groupBy("__block")
    marks = by_block.applyInArrow(_send_grams(shards, length, gram), B.MESSAGE) \
        .groupBy("shard").applyInArrow(_mark_grams(hot), B.MESSAGE)
    least = by_block.cogroup(marks.groupBy("__block")).applyInArrow(_send_stretches(shards, length, gram), B.MESSAGE) \
        .groupBy("shard").applyInArrow(_resolve(length), B.MESSAGE)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields]
                       + ["removed array<struct<start:bigint,end:bigint>>", "kept " + ("string" if as_text else "binary")])
    return by_block.cogroup(marks.union(least).groupBy("__block")).applyInArrow(_cut(length, gram, columns, as_text), schema)

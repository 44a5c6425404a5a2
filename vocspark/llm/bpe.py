"""Operator 2 — byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, one each, so that an Aho-Corasick automaton (pyahocorasick)
over the vocabulary finds every token that occurs in a piece in one pass. Encoding takes the
longest token at each place and steps back to shorter ones where it must: a sequence of tokens is
what BPE's merges give if and only if every two neighbours are compatible, that is, BPE gives just
these two for their joined bytes. Compatibility is decided by undoing merges across the border and
is memoised, as are the pieces themselves (both memos have a size bound).

A worker builds the tables once from the rank file: the vocabulary's size bounds them.

Cases: null encodes as the empty text, with no tokens; equal texts give equal ids; an empty table
gives an empty table; columns of docs pass through unless named as one of the results.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textarrays import trim

PAIRS_KEPT = 1 << 18
PIECES_KEPT = 1 << 18  # in each of two generations
PIECE_KEPT = 64  # characters
BATCH = 1000  # texts held as Python strings at a time


class Memo(dict):
    """Remembers `make(piece)` for short pieces, packed as 32-bit numbers, in two generations of at
    most PIECES_KEPT each."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = array("I", self.make(piece.encode())).tobytes()
        if len(piece) <= PIECE_KEPT:
            if len(self) >= PIECES_KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Codec:
    """Encodes and decodes with the ranks of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter_of: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for i in range(len(tokens)):  # in order of rank, so that a token's parts are known before it
            if (parts := self._parts(i)) is not None:
                self.merged[parts] = i
        self.compatible = lru_cache(PAIRS_KEPT)(self._compatible)
        self.memo = Memo(self.encode_piece)

    def _parts(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token i: the split whose halves are compatible."""
        t = self.tokens[i]
        found = None
        for k in range(1, len(t)):
            a, b = self.rank.get(t[:k], i), self.rank.get(t[k:], i)
            if a < i and b < i and self._compatible(a, b, i):
                found = (a, b)
                break
        self.halves[i] = found
        return found

    def _compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether BPE keeps tokens a and b apart. Undoes the later of their last merges again and
        again; an undone merge must not come after one that joins what then meets at the border."""
        limit = below if below is not None else len(self.tokens)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                parts = self.halves[a]
                if parts is not None:
                    limit, a = a, parts[1]
                    continue
                parts = self.halves[b]
                if parts is None:
                    return True
                limit, b = b + 1, parts[0]
            else:
                parts = self.halves[b]
                if parts is not None:
                    limit, b = b + 1, parts[0]
                    continue
                parts = self.halves[a]
                if parts is None:
                    return True
                limit, a = a, parts[1]

    def _shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of token i; -1 if there is none."""
        if (found := self.shorter_of.get(i)) is None:
            t = self.tokens[i]
            found = next((r for k in range(len(t) - 1, 0, -1) if (r := self.rank.get(t[:k])) is not None), -1)
            self.shorter_of[i] = found
        return found

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - len(self.tokens[token])] = token  # ends ascend: the last is the longest
        reachable = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            if token < 0:  # no token fits here: the one before must end elsewhere
                reachable[at] = 0
                token = out.pop()
                at -= len(self.tokens[token])
                token = self._shorter(token)
                continue
            end = at + len(self.tokens[token])
            if reachable[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            else:
                token = self._shorter(token)
        return tuple(out)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers, each match of the pattern separately."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """A worker's own codec, built at its first use."""
    return Codec(read_ranks(path), pattern)


RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def encode(docs: DataFrame, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """docs with the ids of each whole text (array<int>)."""
    return _per_text(docs, [f"{out} array<int>"], [out], path, pattern, _ids)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The inverse of `encode`: the column `out` from the column `ids` (null: the empty text)."""
    kept = [c for c in encoded.columns if c != out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema.fields] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [c.decode(x or []).decode("utf-8", errors="replace") for x in column.to_pylist()]
            own = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], names=[*kept, out])

    return encoded.select(*kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """The columns `keep` of docs (all by default) with RESULTS: the number of ids, and digests of
    the ids and of the bytes that they decode to."""
    fields = ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"]
    return _per_text(docs, fields, list(RESULTS), path, pattern, _digests, keep)


def _ids(c: Codec, texts: list[str]) -> list[pa.Array]:
    packed = [c.packed(t) for t in texts]
    offsets = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.uint32).astype(np.int32)))]


def _digests(c: Codec, texts: list[str]) -> list[pa.Array]:
    counts, ids, decoded = [], [], []
    names = [str(i) for i in range(len(c.tokens))]
    for t in texts:
        own = c.encode(t)
        counts.append(len(own))
        ids.append(hashlib.sha256(" ".join(map(names.__getitem__, own)).encode()).hexdigest())
        decoded.append(hashlib.sha256(c.decode(own)).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]


def _per_text(docs: DataFrame, fields: list[str], names: list[str], path: str, pattern: str, work, keep=()) -> DataFrame:
    kept = [c for c in (keep or docs.columns) if c not in names]
    source = docs.select(*kept, *(() if "text" in kept else ("text",)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            trim()
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                results = work(c, [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()])
                own = [batch.column(batch.schema.get_field_index(k)) for k in kept]
                yield pa.RecordBatch.from_arrays(own + results, names=[*kept, *names])

    return source.mapInArrow(run, schema)

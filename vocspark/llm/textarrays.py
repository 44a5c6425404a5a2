"""Whole texts as byte arrays: words, lines and their hashes, for a batch of documents at once.

Everything here works on numpy arrays inside a task. Hashes are 64 bits wide: a sum of per-byte
random values times powers of an odd number, so that the hash of any piece follows from running
sums, then mixed. Batches are cut into chunks of about `CHUNK` bytes of whole documents to bound
the arrays; one longer document is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def trim() -> None:
    """Returns memory that earlier batches or groups have freed to the system: workers live on, and two
    of them share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def distinct(a: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    a = np.sort(a)
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = a[1:] != a[:-1]
    return a[fresh]


_BYTE = mixed(np.arange(1, 257, dtype=U) * _BASE)
_powers = np.ones(1, dtype=U)
_inverses = np.ones(1, dtype=U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            size = max(n, CHUNK + CHUNK // 4)
            _powers = np.concatenate([[U(1)], np.full(size - 1, _BASE, dtype=U)]).cumprod(dtype=U)
            _inverses = np.concatenate([[U(1)], np.full(size - 1, _BASE_INVERSE, dtype=U)]).cumprod(dtype=U)
    return _powers, _inverses


class Texts:
    """The bytes of some documents, one after another; offsets has one more entry than documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def lower(self) -> "Texts":
        """A-Z become a-z."""
        return Texts(LOWER[self.data], self.offsets)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each document has."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def prefix_sums(self) -> np.ndarray:
        powers, _ = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=U)
        np.cumsum(_BYTE[self.data] * powers[: len(self.data)], out=sums[1:])
        return sums

    def piece_hashes(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each piece [start, end)."""
        _, inverses = _power_tables(len(self.data) + 1)
        return mixed((sums[ends] - sums[starts]) * inverses[starts])

    def gram_hashes(self, sums: np.ndarray, width: int) -> np.ndarray:
        """The hash of the `width` bytes from each place that has so many after it."""
        n = max(len(self.data) - width + 1, 0)
        _, inverses = _power_tables(len(self.data) + 1)
        return mixed((sums[width: width + n] - sums[:n]) * inverses[:n])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the number of words before each document (n + 1)."""
        solid = ~SPACE[self.data]
        if not len(solid):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(self.n + 1, dtype=np.int64)
        follows = np.empty_like(solid)
        follows[0] = False
        follows[1:] = solid[:-1]
        edges = self.offsets[:-1]
        follows[edges[edges < len(solid)]] = False
        starts = np.flatnonzero(solid & ~follows)
        precedes = np.empty_like(solid)
        precedes[-1] = False
        precedes[:-1] = solid[1:]
        inner = self.offsets[1:]
        precedes[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(solid & ~precedes) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines (pieces between newlines), and the document of each."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        # a document's own start precedes its other lines; with empty documents, positions repeat
        doc = np.repeat(np.arange(self.n), 1 + np.diff(np.searchsorted(breaks, self.offsets)))
        return starts, ends, doc


def window_hashes(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words inside a document: (hash, first word, document)."""
    n = len(words) - width + 1
    counts = np.maximum(np.diff(before) - width + 1, 0)
    doc = np.repeat(np.arange(len(before) - 1), counts)
    if n <= 0 or not len(doc):
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), doc[:0]
    acc = words[:n].copy()
    for k in range(1, width):
        acc *= _STEP
        acc += words[k: k + n]
    first = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(before[:-1], counts)
    return mixed(acc[first]), first, doc


def chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, Texts]]:
    """(index of the first document, Texts) over a string column; null is an empty text."""
    trim()
    done = 0
    for part in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]):
        part = part.cast(pa.large_binary()).fill_null(b"")
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset: part.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = part.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield done + at, Texts(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at])
            at = to
        done += n

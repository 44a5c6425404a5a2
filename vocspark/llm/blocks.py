"""Exchanges between blocks of documents and shards of keys.

Some statistics need every piece of every text (n-grams, anchors, shingles) to meet its equals.
Sending each piece as a row of its own would move many times the input. Instead

1. documents go to blocks of about BLOCK_BYTES by a hash: one shuffle of the texts, which later
   steps reuse, as they partition alike;
2. each block sends every shard one message: its own distinct keys in that shard's range, sorted
   and packed, with what it knows of them. A key that a third of all documents hold is one entry
   per block, so no shard sees a hot key;
3. each shard merges its messages and answers each block, entry by entry;
4. blocks meet their answers in a cogroup by block.

Blocks and shards are a fixed number of bytes, so their number grows with the input and the memory
of a task does not. All steps are deterministic, so lost tasks are simply run again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import U, trim

BLOCK_BYTES = 16 << 20


def n_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, least_bytes: int = 1 << 20) -> int:
    """How many blocks there are: of about block_bytes of text each, or, so that a small input keeps
    all cores busy, as many as there are shuffle partitions, of about least_bytes or more."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(total / block_bytes), min(partitions, math.ceil(total / min(least_bytes, block_bytes))))


def blocked(docs: DataFrame, blocks: int, *keep: str) -> DataFrame:
    """The columns `keep`, text and __block; rows are dealt by id and text."""
    return docs.select(*keep, *(() if "text" in keep else ("text",)),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("__block"))


MESSAGE = "__block int, shard int, kind int, body binary"
MESSAGE_ARROW = pa.schema([("__block", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, MESSAGE_ARROW, strict=True)], schema=MESSAGE_ARROW)


def read_messages(table: pa.Table, kind: int | None = None) -> list[tuple[int, int, bytes]]:
    """(block, shard, body), ordered by block and shard."""
    trim()
    rows = zip(table.column("__block").to_pylist(), table.column("shard").to_pylist(),
               table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True)
    return sorted((b, s, body) for b, s, k, body in rows if kind is None or k == kind)


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins and ends in sorted keys (shards + 1 places)."""
    starts = np.array([(i << 64) // shards for i in range(shards)], dtype=U)
    return np.append(np.searchsorted(keys, starts), len(keys))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed body; sorted 64-bit keys should be given as `gaps`."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (a.dtype.num, a.nbytes)], dtype=np.int64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)[1:].reshape(n, 2)
    out, at = [], 8 * (1 + 2 * n)
    for kind, size in head.tolist():
        dtype = _DTYPES[kind]
        plane = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, -1) if size else np.zeros((dtype.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(dtype))
        at += size
    return out


_DTYPES = {np.dtype(t).num: np.dtype(t) for t in
           (np.uint8, np.int8, np.uint16, np.int16, np.uint32, np.int32, np.uint64, np.int64, np.bool_)}


def gaps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, the first from 0: mostly small numbers, which compress."""
    return np.diff(keys, prepend=U(0))


def ungaps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=U)


def narrow(counts: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the smallest unsigned type that holds them."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)

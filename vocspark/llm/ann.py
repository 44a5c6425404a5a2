"""Operator 8 — approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner products are the smallest Euclidean distances once every vector gets a further
component that brings its norm to the largest one, and queries are scaled to that norm. A table
hashes a vector to the integer parts of (a_i . v + b_i) / W with Gaussian a_i. A query visits its
own bucket and those with hash values one up or down, in the order of their estimated success: a
step costs the square of the distance to that border of the bucket. Candidates of all tables are
merged and ranked by the exact inner product, in double precision.

W and the number of probes are fitted on a bounded sample: the exact neighbours of SAMPLE vectors
among all vectors. W follows the distance of the last neighbour of most of them (NEAR). Probes are
taken until `recall` is reached for the neighbours up to that distance, for the farthest tenth of
these, and for a neighbour at that distance by the model of the hash functions; where all probes are
not enough, W grows.

Rows that repeat an id and its vector are made one first. The index is dealt by bucket. A bucket
larger than BUCKET_ROWS is dealt to several shards by a hash of the row, and its probes go to all of
them, so that neither one vector of a third of all ids nor one id with many vectors makes a large
task. Each shard keeps the best k ids of each query and sends only these on.

A query that finds fewer than k, or whose k-th found is farther than the distance up to which the
fitted probes reach `recall`, is compared with all vectors, which is exact. So no query depends on
its density being that of the sample.

Cases: vectors that are null, of norm 0, with null or non-finite components or another length than
most have, take no part, nor do null ids; ties go to the smaller id; a repeated id counts once,
with its best score, and never as its own neighbour, and asks with its smallest vector; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage

TABLES = 2
FUNCTIONS = 6
SAMPLE = 64
RECALL = 0.97
NEAR = 0.95
DRAWS = 2000
BUCKET_ROWS = 8192
SHARD_ROWS = 100_000
LEAST_SHARDS = 12
SEED = 11


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.select(F.col(id).cast("long").alias("id"), v.alias("v"), norm.alias("norm2"))
    # a null, NaN or infinite component makes the sum null, NaN or infinite; it can overflow only beyond 1e154
    return rows.where((F.col("norm2") > 0) & (F.col("norm2") < float("inf")) & F.col("id").isNotNull())


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int):
    """The best k ids of some vectors for each query, with their best rows: (query's row, vector's row, exact score)."""
    rough = queries @ vectors.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    names, group = np.unique(ids, return_inverse=True)
    top = rough
    if len(names) < len(ids):  # an id stands once among the k, by its best row
        order = np.argsort(group, kind="stable")
        top = np.maximum.reduceat(rough[:, order], np.searchsorted(group[order], np.arange(len(names))), axis=1)
        rough[rough < (top - 1e-9 * (1 + np.abs(top)))[:, group]] = -np.inf
    if len(names) > k:
        least = np.partition(top, len(names) - k, axis=1)[:, len(names) - k][:, None]
        keep = rough >= least - 1e-9 * (1 + np.abs(least))
    else:
        keep = np.ones(rough.shape, dtype=bool)
    keep &= np.isfinite(rough)
    q, v = np.nonzero(keep)
    return q, v, np.concatenate([(queries[q[at: at + 65536]] * vectors[v[at: at + 65536]]).sum(axis=1)
                                 for at in range(0, len(q), 65536)] or [np.zeros(0)])


def _first_k(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the best k of their query, each id once; ties to smaller ids."""
    order = np.lexsort((-score, ids, q))
    once = np.ones(len(order), dtype=bool)
    once[1:] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[once]
    order = order[np.lexsort((ids[order], -score[order], q[order]))]
    starts = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


@dataclass(frozen=True)
class Hashing:
    """The hash functions of all tables and how many probes a query makes in each."""

    a: np.ndarray  # table, component (with the further one), function
    b: np.ndarray  # table, function
    width: float
    norm: float
    probes: int

    def codes(self, v: np.ndarray) -> np.ndarray:
        """The bucket of each vector (rows) in each table (columns)."""
        extra = np.sqrt(np.maximum(self.norm ** 2 - (v * v).sum(axis=1), 0))
        return np.stack([_packed(np.floor(self._places(np.column_stack([v, extra]), t))) for t in range(len(self.a))], axis=1)

    def reach(self, recall: float = RECALL) -> float:
        """The distance up to which the probes find `recall` of the neighbours."""
        share, near, far = _of_one(recall, len(self.a)), 0.0, 4.0
        for _ in range(20):
            middle = (near + far) / 2
            if _place_for(_places_of(middle, self.b.shape[1]), share) < self.probes:
                near = middle
            else:
                far = middle
        return near * self.width

    def _places(self, v: np.ndarray, table: int) -> np.ndarray:
        return (v @ self.a[table]) / self.width + self.b[table]

    def visits(self, q: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """The buckets that each query visits, in the order of estimated success."""
        scaled = q * (self.norm / np.linalg.norm(q, axis=1, keepdims=True))
        place = self._places(np.column_stack([scaled, np.zeros(len(q))]), table)
        home = np.floor(place)
        down = place - home
        steps = _steps(place.shape[1])
        cost = (down ** 2) @ (steps < 0).T + ((1 - down) ** 2) @ (steps > 0).T
        order = np.argsort(cost, axis=1, kind="stable")[:, : probes or self.probes]
        return np.stack([_packed(home[i] + steps[order[i]]) for i in range(len(q))]) if len(q) else np.zeros((0, 0), np.int64)


def _places_of(ratio: float, functions: int) -> np.ndarray:
    """Places, among a query's probes, of the bucket of a neighbour that is `ratio` widths away, for
    DRAWS random hash functions; the number of all probes where none reaches it."""
    rng, steps = np.random.default_rng(SEED), _steps(functions)
    down, move = rng.random((DRAWS, functions)), ratio * rng.normal(size=(DRAWS, functions))
    step = np.floor(down + move)
    cost = (down ** 2) @ (steps < 0).T + ((1 - down) ** 2) @ (steps > 0).T
    own = (down ** 2 * (step < 0) + (1 - down) ** 2 * (step > 0)).sum(axis=1)
    return np.where(np.abs(step).max(axis=1) > 1, len(steps), (cost < own[:, None] - 1e-12).sum(axis=1))


def _place_for(places: np.ndarray, share: float) -> int:
    """The place up to which `share` of some neighbours are found."""
    return int(np.sort(places)[min(len(places) - 1, max(int(np.ceil(share * len(places))) - 1, 0))])


def _of_one(recall: float, tables: int) -> float:
    """What one table has to find for all tables to find `recall`."""
    return 1 - (1 - recall) ** (1 / tables)


def _steps(n: int) -> np.ndarray:
    return np.array(list(product((0, -1, 1), repeat=n)), dtype=np.int64)


def _packed(values: np.ndarray) -> np.ndarray:
    """Hash values (rows) as one number each."""
    key = np.zeros(values.shape[:-1], dtype=np.uint64)
    for i in range(values.shape[-1]):
        key = key * np.uint64(0x9E3779B97F4A7C15) + values[..., i].astype(np.int64).view(np.uint64) + np.uint64(1)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _one_each(rows: DataFrame) -> DataFrame:
    """The smallest vector of each id."""
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def fit(rows: DataFrame, dim: int, norm: float, k: int, tables: int = TABLES, functions: int = FUNCTIONS,
        recall: float = RECALL, sample: int = SAMPLE, seed: int = SEED) -> Hashing:
    """Hash functions whose probes find `recall` of the exact neighbours of `sample` vectors."""
    picked = _one_each(rows).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    queries, own = np.array([r["v"] for r in picked]), np.array([r["id"] for r in picked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            q, at, score = _best(queries, ids, v, own, k)
            best = _first_k(q, ids[at], score, k)
            yield pa.RecordBatch.from_arrays([pa.array(q[best]), pa.array(score[best]), pa.array(ids[at[best]]),
                                              pa.array(list(v[at[best]]), pa.list_(pa.float64()))], names=["q", "score", "id", "v"])

    found = rows.select("id", "v").mapInArrow(run, "q bigint, score double, id bigint, v array<double>")
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.groupBy("q", "id").agg(F.max_by("v", "score").alias("v"), F.max("score").alias("score"))
    near = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).orderBy("q", "r").collect()  # sample * k
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(tables, dim + 1, functions)), rng.random((tables, functions))
    every = 3 ** functions
    if not near:
        return Hashing(a, b, 1.0, norm, every)
    q, v = np.array([r["q"] for r in near]), np.array([r["v"] for r in near])
    cosine = (queries[q] * v).sum(axis=1) / (norm * np.linalg.norm(queries[q], axis=1))
    distance = norm * np.sqrt(np.maximum(2 - 2 * cosine, 0))
    last = np.zeros(len(queries))
    np.maximum.at(last, q, distance)
    aim = float(np.quantile(last[np.unique(q)], NEAR, method="higher"))
    q, v, distance = q[distance <= aim], v[distance <= aim], distance[distance <= aim]
    far = distance >= np.quantile(distance, 0.9)
    width = max(1.5 * aim, 1e-6 * norm)
    while True:
        h = Hashing(a, b, width, norm, every)
        codes, first = h.codes(v), np.full(len(v), every)
        for t in range(tables):
            hit = h.visits(queries, t)[q] == codes[:, t][:, None]
            first = np.minimum(first, np.where(hit.any(axis=1), hit.argmax(axis=1), every))
        modelled = _place_for(_places_of(aim / width, functions), _of_one(recall, tables))
        needed = max(_place_for(first, recall), _place_for(first[far], recall), modelled)
        if needed < every:
            return Hashing(a, b, width, norm, needed + 1)
        width *= 1.25  # in the end all vectors are in neighbouring buckets


def _coded(rows: DataFrame, h: Hashing, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = h.codes(_matrix(batch.column(1), dim))
            for t in range(codes.shape[1]):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(codes), t, np.int32)),
                                                  pa.array(np.ascontiguousarray(codes[:, t]))], names=["id", "v", "t", "code"])

    return rows.select("id", "v").mapInArrow(run, "id bigint, v array<double>, t int, code bigint")


def _visits(queries: DataFrame, h: Hashing, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            for at in range(0, len(ids), 256):
                for t in range(len(h.a)):
                    codes = h.visits(v[at: at + 256], t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[at: at + 256], codes.shape[1])), pa.array(np.full(codes.size, t, np.int32)),
                         pa.array(codes.reshape(-1))], names=["q", "t", "code"])

    return queries.select("id", "v").mapInArrow(run, "q bigint, t int, code bigint")


def _search(probes: DataFrame, queries: DataFrame, dealt: DataFrame, buckets: DataFrame, dim: int, k: int, shards: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each shard for the queries that probe it."""
    def shard(salt: Column) -> Column:
        return F.pmod(F.xxhash64("t", "code", salt), F.lit(shards)).cast("int")

    asked = (probes.join(buckets, ["t", "code"])
             .select("q", "t", "code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
             .groupBy("q", shard(F.col("salt")).alias("shard"))
             .agg(F.collect_set(F.xxhash64("t", "code", "salt")).alias("cells"))  # at most tables * probes cells
             .join(queries.select(F.col("id").alias("q"), "v"), "q"))

    def run(key: tuple, vectors: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(vectors) or not len(asking):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, v, cell = vectors.column("id").to_numpy(), _matrix(vectors.column("v"), dim), vectors.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        ids, v, cell = ids[order], v[order], cell[order]
        cells, first = np.unique(cell, return_index=True)
        last = np.append(first[1:], len(cell))
        own, q = asking.column("q").to_numpy(), _matrix(asking.column("v"), dim)
        lists = asking.column("cells").combine_chunks()
        wanted = lists.flatten().to_numpy()
        asker = np.repeat(np.arange(len(own)), np.diff(lists.offsets.to_numpy()))
        by_cell = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[by_cell], asker[by_cell]
        lo, hi = np.searchsorted(wanted, cells), np.searchsorted(wanted, cells, side="right")
        parts: list[tuple] = []
        held = 0

        def cut() -> tuple:
            who, at, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
            best = _first_k(who, ids[at], score, k)
            return who[best], at[best], score[best]

        for c in range(len(cells)):
            for begin in range(lo[c], hi[c], 1024):
                who = asker[begin: min(hi[c], begin + 1024)]
                a, b, score = _best(q[who], ids[first[c]: last[c]], v[first[c]: last[c]], own[who], k)
                parts.append((who[a], b + first[c], score))
                held += len(a)
                if held > 4_000_000:
                    parts = [cut()]
                    held = len(parts[0][0])
        if not parts:
            parts = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        who, at, score = cut()
        return pa.table([pa.array(own[who]), pa.array(ids[at]), pa.array(score)], names=names)

    return dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")


def _exact(queries: DataFrame, rows: DataFrame, dim: int, k: int, shards: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of each shard of all rows."""
    asked = queries.select(F.col("id").alias("q"), "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"))

    def run(key: tuple, vectors: pa.Table, asking: pa.Table) -> pa.Table:
        ids, v = vectors.column("id").to_numpy(), _matrix(vectors.column("v"), dim)
        own, q = asking.column("q").to_numpy(), _matrix(asking.column("v"), dim)
        parts = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        for begin in range(0, len(own), 1024):
            who, at, score = (np.concatenate(x) for x in zip(*[
                (a, b + first, s) for first in range(0, len(ids), BUCKET_ROWS)
                for a, b, s in [_best(q[begin: begin + 1024], ids[first: first + BUCKET_ROWS], v[first: first + BUCKET_ROWS],
                                      own[begin: begin + 1024], k)]])) if len(ids) else parts[0]
            best = _first_k(who, ids[at], score, k)
            parts.append((who[best] + begin, at[best], score[best]))
        who, at, score = (np.concatenate(x) for x in zip(*parts))
        return pa.table([pa.array(own[who]), pa.array(ids[at]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding",
           hashing: Hashing | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where `is_query` (over `id`) holds."""
    rows = usable(vectors, id, vector)
    widths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("norm2")).alias("norm"))
    common = widths.orderBy(F.desc("n"), "dim").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = common["dim"], common["n"]
    rows = cut_lineage(rows.where(F.size("v") == dim).select("id", "v").distinct())
    h = hashing or fit(rows, dim, common["norm"], k)
    shards = max(LEAST_SHARDS, -(-n * len(h.a) // SHARD_ROWS))
    queries = _one_each(rows.withColumnRenamed("id", id).where(is_query).withColumnRenamed(id, "id"))
    coded = _coded(rows, h, dim)
    buckets = coded.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("parts"))
    salted = coded.join(buckets, ["t", "code"]).withColumn("salt", F.pmod(F.xxhash64("id", "v"), "parts").cast("int"))
    dealt = salted.select("id", "v", F.xxhash64("t", "code", "salt").alias("cell"),
                          F.pmod(F.xxhash64("t", "code", "salt"), F.lit(shards)).cast("int").alias("shard"))
    found = _search(_visits(queries, h, dim), queries, dealt, buckets, dim, k, shards)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(df: DataFrame) -> DataFrame:
        return (df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    result = cut_lineage(ranked(found))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    least = length * F.lit(h.norm - h.reach() ** 2 / (2 * h.norm))  # the inner product at that distance
    kth = result.where(F.col("rank") == k).select("query_id", "score")
    short = (queries.join(kth, F.col("id") == F.col("query_id"), "left")
             .where(F.col("score").isNull() | (F.col("score") < least)).select("id", "v"))
    short = cut_lineage(short)
    if short.isEmpty():
        return result
    exact = ranked(_exact(short, rows, dim, k, shards))
    return result.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*exact.columns).union(exact)

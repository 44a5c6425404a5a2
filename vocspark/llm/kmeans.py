"""Operator 12 — centroid clustering with the threshold algorithm as nearest-centroid search.

Vectors become integers, floor(scale * x), so that distances, sums and ties are exact. For each
dimension the centroids are kept in a list sorted by their value. A vector's search walks every list
outward from the vector's own value, one centroid a list and step. A centroid met for the first time
gets its exact squared distance. The frontier is the sum over all dimensions of the squared gaps last
reached: no centroid unseen so far can be nearer. The search ends when the frontier strictly exceeds
the best exact distance, so that equally near centroids have all been met and the smallest number wins.

Each round is one map over the vectors. A task sends, for each centroid, the count and the sums of its
vectors; Spark adds them, and the driver gets one row for each centroid (k rows of `dims` numbers,
whatever the input). Centroids travel inside the tasks' closure: k * dims numbers.

Cases: vectors that are null, of another size, or with null or non-finite components take no part, nor
do those with a component beyond +-2**27 after scaling (no long could hold their distances). Fewer
vectors than centroids make fewer clusters; no vectors give an empty result. Repeated rows are vectors
of their own; equal hashes (repeated ids) are ordered by the vector. Extra columns are dropped unless
asked for in `keep`; the names of results are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows

SCALE = 64
K = 16
ROUNDS = 3
BOUND = 1 << 27
RESULTS = {"cluster": "int", "distance": "bigint"}
#: Vectors searched at once: bounds the arrays of a step.
BATCH = 2048


def whole_vectors(table: DataFrame, vector: str, dims: int, scale: int = SCALE) -> DataFrame:
    """Adds __v, the vector as whole numbers, and drops the rows that take no part."""
    x = F.col(vector)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    ok = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= BOUND / scale))
    return table.where(F.coalesce(ok, F.lit(False))).withColumn("__v", v)  # NaN exceeds every bound


def first_centroids(vectors: DataFrame, vec_id: str, k: int = K, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:id`, in that order (a top-k: k rows reach the driver)."""
    name = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(vec_id).cast("string"), F.lit("null"))), 256)
    rows = vectors.select(name.alias("h"), "__v").orderBy("h", "__v").limit(k).collect()
    return np.array([r["__v"] for r in rows], dtype=np.int64)


@dataclass(frozen=True)
class SortedLists:
    """For each dimension the centroids' values in ascending order, and whose they are."""

    centroids: np.ndarray  # centroid, dimension
    values: np.ndarray     # dimension, place
    owners: np.ndarray     # dimension, place

    @staticmethod
    def of(centroids: np.ndarray) -> "SortedLists":
        order = np.argsort(centroids, axis=0, kind="stable").T
        return SortedLists(centroids, np.take_along_axis(centroids.T, order, axis=1), order)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row of x; ties to the smaller number."""
        n, dims = x.shape
        k = len(self.centroids)
        best, number = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        # the next place below and above the vector's own value, in each list
        above = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], axis=1)
        below = above - 1
        seen = np.zeros((n, k), dtype=bool)
        live = np.arange(n)
        d = np.arange(dims)
        far = np.int64(4 * BOUND)  # beyond any gap: an exhausted side
        for step in range(k):
            own = x[live]
            lo, hi = below[live], above[live]
            gap_lo = np.where(lo >= 0, own - self.values[d, np.maximum(lo, 0)], far)
            gap_hi = np.where(hi < k, self.values[d, np.minimum(hi, k - 1)] - own, far)
            down = gap_lo <= gap_hi
            met = self.owners[d, np.where(down, lo, hi)]
            gap = np.where(down, gap_lo, gap_hi)
            below[live] = lo - down
            above[live] = hi + ~down
            fresh = np.zeros((len(live), k), dtype=bool)
            fresh[np.arange(len(live))[:, None], met] = True
            fresh &= ~seen[live]
            seen[live] |= fresh
            for c in np.flatnonzero(fresh.any(axis=0)):
                at = np.flatnonzero(fresh[:, c])
                gaps = own[at] - self.centroids[c]
                exact = (gaps * gaps).sum(axis=1)
                rows = live[at]
                wins = (exact < best[rows]) | ((exact == best[rows]) & (c < number[rows]))
                best[rows[wins]], number[rows[wins]] = exact[wins], c
            live = live[(gap * gap).sum(axis=1) <= best[live]]
            if not len(live):
                break
        return number, best


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assign(vectors: DataFrame, centroids: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`, cluster and distance (squared) of each vector."""
    lists, dims = SortedLists.of(centroids), centroids.shape[1]

    def run(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for at in range(0, len(columns[0]), BATCH):
            part = columns[0].slice(at, BATCH)
            number, distance = lists.nearest(_vectors(part, dims))
            yield at, len(part), [pa.array(number.astype(np.int32)), pa.array(distance)]

    return map_rows(vectors, keep, [vectors["__v"]], run, RESULTS)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid becomes the floor of the mean of its vectors, exactly; without vectors it stays."""
    lists, (k, dims) = SortedLists.of(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = _vectors(batch.column(0).slice(at, BATCH), dims)
                number, _ = lists.nearest(x)
                counts += np.bincount(number, minlength=k)
                for c in np.unique(number):
                    sums[c] += x[number == c].sum(axis=0)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(counts[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "s"])

    parts = vectors.select("__v").mapInArrow(run, "cluster int, n bigint, s array<bigint>")
    total = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(dims)]).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # one row for each centroid
        out[r["cluster"]] = [int(s) // r["n"] for s in r["s"]]
    return out


def fit(vectors: DataFrame, vec_id: str, k: int = K, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """The centroids after `rounds` rounds; no rows without vectors."""
    centroids = first_centroids(vectors, vec_id, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def centroid_name(centroid: np.ndarray) -> Column:
    """Lowercase hex sha256 of the components, joined by commas."""
    return F.sha2(F.lit(",".join(map(str, centroid.tolist()))), 256)


def cluster(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64,
            scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    vectors = whole_vectors(table, vector, dims, scale)
    centroids = fit(vectors, vec_id, k, rounds, seed)
    if not len(centroids):
        empty = f"`{vec_id}` {table.schema[vec_id].dataType.simpleString()}"
        return table.sparkSession.createDataFrame(
            [], f"{empty}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    placed = cut_lineage(assign(vectors, centroids, (vec_id,)))
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    pick = F.create_map(*[x for c, s in sums.items() for x in (F.lit(c), F.struct(
        F.lit(s).cast("bigint").alias("s"), centroid_name(centroids[c]).alias("name")))])
    own = pick[F.col("cluster")]
    return placed.select(vec_id, "cluster", "distance", own["s"].alias("cluster_inertia"),
                         F.lit(sum(sums.values())).cast("bigint").alias("inertia"), own["name"].alias("centroid_sha256"))

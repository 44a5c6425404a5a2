"""Factorisations of (sparse) rows: truncated SVD, non-negative matrix factorisation, and the text
encoder built on them (M6, M8, M14).

The rows stay distributed and are never joined with the factors. What the driver holds is the other
side: a matrix of `width` (vocabulary, bounded by `max_features`) by `k` numbers. Every pass maps the
rows in Arrow batches against that matrix, adds up what the pass needs inside the task (for instance
the transposed product, width x k) and sends one partial row for each term met; Spark adds the partial
rows and the driver collects width x k numbers. Shuffle and memory follow tasks x width x k, not the
number of rows, and nothing of the row side is kept between passes, so a lost executor repeats its
tasks of one pass only.

* SVD: subspace iteration from a seeded start, then Rayleigh-Ritz.
* NMF: alternating non-negative least squares. Row weights are solved anew from the components in
  every pass; the components are then improved by coordinate descent from the sums of that pass, where
  the sums are: the driver gets sums of k x k numbers and the new components.
  The start is NNDSVD. The reconstruction error comes out of the same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocspark.session import written

#: Entries of one piece of rows: bounds a task's arrays to about this many times k numbers.
PIECE = 1 << 17
#: Numbers in one block of a partial sum (32 KB).
BLOCK = 1 << 12
#: Up to so many numbers (512 KB) a factor goes through the driver as it is in every pass.
SMALL = 1 << 16


@dataclass(frozen=True)
class Rows:
    """A piece of sparse rows: row r has the entries offsets[r] to offsets[r + 1] and stands for weight[r] rows."""

    offsets: np.ndarray
    index: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def dot(self, q: np.ndarray) -> np.ndarray:
        """The rows times a matrix of width x k."""
        out = np.zeros((self.n, q.shape[1]))
        bounds = self.offsets.tolist()
        for r, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                np.dot(self.value[a:b], q[self.index[a:b]], out=out[r])
        return out

    def add_transposed(self, p: np.ndarray, acc: np.ndarray) -> None:
        """Adds the transposed rows times p (one row of p for each row) to acc (width x k). The entries of
        a row have different indices."""
        bounds = self.offsets.tolist()
        for r, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                acc[self.index[a:b]] += self.value[a:b, None] * p[r]


def _pieces(column: pa.Array, weight: pa.Array | None = None) -> Iterator[tuple[int, Rows]]:
    """(first row, rows) over a column of MLlib vectors or of double arrays; null is an empty row.
    Only the rows of one piece are turned into numpy arrays at a time."""
    values = column.to_pylist() if pa.types.is_struct(column.type) and column.null_count else None
    if values is not None:  # rare: rows without features
        empty = {"type": 0, "size": 0, "indices": [], "values": []}
        column = pa.array([v or empty for v in values], column.type)
    if pa.types.is_struct(column.type):
        kind = column.field("type").to_numpy(zero_copy_only=False)
        if (kind == 1).any():  # dense ones among them
            index = [v["indices"] if v["type"] == 0 else list(range(len(v["values"]))) for v in column.to_pylist()]
            indices = pa.array(index, pa.list_(pa.int32()))
        else:
            indices = column.field("indices")
        lists = column.field("values")
    else:
        lists, indices = column.fill_null([]) if column.null_count else column, None
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        value = lists.slice(at, to - at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        own = offsets[at:to + 1] - offsets[at]
        if indices is None:
            index = np.arange(len(value)) - np.repeat(own[:-1], sizes[at:to])
        else:
            index = indices.slice(at, to - at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.ones(to - at) if weight is None else weight.slice(at, to - at).to_numpy(zero_copy_only=False).astype(np.float64)
        yield at, Rows(own, index, value, n)
        at = to


def rows_in_block(k: int) -> int:
    return max(1, BLOCK // k)


def block_sums(features: DataFrame, shape: tuple[int, int], add: Callable[[Rows, np.ndarray], None], wire: str = "double") -> DataFrame:
    """(block, numbers): the sum over all rows of what `add` adds to a matrix of that shape, one piece of rows at a time.

    features: one column, or a second with the number of rows that each stands for. A task sends its matrix in blocks of about BLOCK numbers, zero blocks left out;
    blocks of one number are added up in one task, which holds tasks x BLOCK numbers. The sums are made in double
    precision and come as `wire` (float or double)."""
    n, k = shape
    rows_each = rows_in_block(k)
    n_blocks = -(-n // rows_each)
    number = pa.float32() if wire == "float" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((n_blocks * rows_each, k))
        for batch in batches:
            for _, rows in _pieces(batch.column(0), batch.column(1) if batch.num_columns > 1 else None):
                add(rows, acc[:n])
        for i in range(n_blocks):
            own = acc[i * rows_each:(i + 1) * rows_each]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.ravel()], pa.list_(pa.float64()))],
                                                 names=["block", "numbers"])

    def add_up(group: pa.Table) -> pa.Table:
        parts = group.column("numbers").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        numbers = parts.sum(axis=0).astype(number.to_pandas_dtype())
        return pa.table({"block": group.column("block")[:1], "numbers": pa.array([numbers], pa.list_(number))})

    return features.mapInArrow(run, "block int, numbers array<double>").groupBy("block").applyInArrow(add_up, f"block int, numbers array<{wire}>")


def collected(sums: DataFrame, shape: tuple[int, int], first: int = 0) -> np.ndarray:
    """The matrix of that shape whose blocks are those of `sums` from `first` on: shape[0] x shape[1] numbers."""
    n, k = shape
    rows_each = rows_in_block(k)
    out = np.zeros((-(-n // rows_each), rows_each * k))
    got = sums.toArrow()
    if got.num_rows:
        out[got.column("block").to_numpy() - first] = got.column("numbers").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return out.reshape(-1, k)[:n]


def total(features: DataFrame, shape: tuple[int, int], add: Callable[[Rows, np.ndarray], None], wire: str = "double") -> np.ndarray:
    """The sums of `block_sums` as one matrix."""
    return collected(block_sums(features, shape, add, wire), shape)


def mapped(df: DataFrame, features: str, out: str, fn: Callable[[Rows], np.ndarray]) -> DataFrame:
    """df without `features`, with `out`: an array<double> that fn makes of each row's features.
    Only the features go to Python."""

    @F.arrow_udf("array<double>")
    def made(column: pa.Array) -> pa.Array:
        parts = [fn(rows) for _, rows in _pieces(column)]
        if not parts:
            return pa.array([], pa.list_(pa.float64()))
        m = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (features, out)], made(F.col(f"`{features}`")).alias(out))


def svd(features: DataFrame, width: int, dims: int, passes: int = 4, seed: int = 42,
        extra: int = 8, wire: str = "double") -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, width x dims; singular values) of the rows, without centring. The sums of a
    pass come as `wire`.

    Each pass multiplies a basis of dims + extra vectors by the Gram matrix; signs are fixed by making
    the largest entry of a vector positive."""
    size = min(dims + extra, width)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]

    def gram(q: np.ndarray) -> np.ndarray:
        return total(features, (width, size), lambda rows, acc: rows.add_transposed(rows.dot(q) * rows.weight[:, None], acc), wire)

    for _ in range(passes):
        q = np.linalg.qr(gram(q))[0]
    y = gram(q)
    values, vectors = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    top = np.argsort(-values, kind="stable")[:min(dims, size)]
    v = q @ vectors[:, top]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v * np.where(sign == 0, 1, sign), np.sqrt(np.maximum(values[top], 0))


def solve_weights(g: np.ndarray, b: np.ndarray, sweeps: int = 60, tol: float = 1e-7) -> np.ndarray:
    """Non-negative w (one row for each row of b) least in w g w' / 2 - w b', by coordinate descent."""
    diagonal = np.diag(g)
    live = np.flatnonzero(diagonal > 1e-12)
    w = np.zeros_like(b)
    for _ in range(sweeps):
        change = 0.0
        for j in live:
            new = np.maximum(0.0, w[:, j] + (b[:, j] - w @ g[:, j]) / diagonal[j])
            change = max(change, float(np.abs(new - w[:, j]).max(initial=0)))
            w[:, j] = new
        if change <= tol * max(float(w.max(initial=0)), 1e-12):
            break
    return w


def nndsvd(features: DataFrame, v: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Components (k x width) from the leading singular vectors: of the positive and the negative part
    of each pair the heavier one. The left vectors stay distributed; only the norms of their parts come back."""
    k = len(sigma)
    safe = np.where(sigma > 1e-12, sigma, 1.0)

    def parts(rows: Rows, acc: np.ndarray) -> None:
        u = rows.dot(v) / safe
        acc[0] += rows.weight @ np.maximum(u, 0) ** 2
        acc[1] += rows.weight @ np.minimum(u, 0) ** 2

    left = np.sqrt(total(features, (2, k), parts))
    h = np.zeros((k, len(v)))
    for j in range(k):
        plus, minus = np.maximum(v[:, j], 0), np.maximum(-v[:, j], 0)
        if j == 0:
            h[j] = np.sqrt(sigma[j]) * np.abs(v[:, j])
            continue
        norms = np.linalg.norm(plus), np.linalg.norm(minus)
        weight = left[0, j] * norms[0], left[1, j] * norms[1]
        side = int(weight[1] > weight[0])
        if norms[side] > 0:
            h[j] = np.sqrt(sigma[j] * weight[side]) * (plus, minus)[side] / norms[side]
    return h


@dataclass(frozen=True)
class Nmf:
    """components: k x width, non-negative; errors: Frobenius error of the reconstruction, pass by pass."""

    components: np.ndarray
    errors: tuple[float, ...]

    def weights(self, df: DataFrame, features: str, out: str = "weights") -> DataFrame:
        """Each row's non-negative weights of the components."""
        h = self.components
        g = h @ h.T
        return mapped(df, features, out, lambda rows: solve_weights(g, rows.dot(h.T)))


def fit_nmf(features: DataFrame, width: int, k: int, max_iter: int = 30, tol: float = 1e-4, seed: int = 42,
            inner: int = 10) -> Nmf:
    """NMF of the rows (a column of vectors, and one with the number of rows that each stands for, if they
    differ). Stops when a pass lowers the error by less than tol of it.

    features should be a written table (each pass reads it again)."""
    large = width * k > SMALL
    v, sigma = svd(features, width, min(k, width), seed=seed, wire="float" if large else "double")
    h = np.zeros((k, width))
    h[:len(sigma)] = nndsvd(features, v, sigma)
    first = -(-width // rows_in_block(k))  # the small sums have blocks of their own after those of the components
    at = first * rows_in_block(k)
    errors: list[float] = []
    for _ in range(max_iter):
        g = h @ h.T

        def step(rows: Rows, acc: np.ndarray, h: np.ndarray = h, g: np.ndarray = g) -> None:
            b = rows.dot(h.T)
            w = solve_weights(g, b)
            each = w * rows.weight[:, None]
            rows.add_transposed(each, acc)  # the first `width` rows
            acc[at:at + k] += each.T @ w
            acc[at + k, 0] += rows.value ** 2 @ np.repeat(rows.weight, np.diff(rows.offsets))
            acc[at + k + 1, 0] += (b * each).sum()

        sums = block_sums(features, (at + k + 2, k), step)
        if large:
            sums = written(sums)  # the large ones stay with the tasks
            small = collected(sums.where(F.col("block") >= first), (k + 2, k), first)
        else:
            sums = collected(sums, (at + k + 2, k))
            small = sums[at:]
        a = small[:k]
        errors.append(float(np.sqrt(max(small[-2, 0] - 2 * small[-1, 0] + (a * g).sum(), 0.0))))
        if len(errors) > 1 and errors[-2] - errors[-1] < tol * errors[-2]:
            break
        h = improved_in_tasks(sums.where(F.col("block") < first), h, a, inner) if large else improved(h, sums[:width].T, a, inner)
    return Nmf(h, tuple(errors))


def improved(h: np.ndarray, cross: np.ndarray, a: np.ndarray, inner: int) -> np.ndarray:
    """Components (or some columns of them) after `inner` sweeps of coordinate descent; columns do not depend on one another."""
    h = h.copy()
    for _ in range(inner):
        for j in np.flatnonzero(np.diag(a) > 1e-12):
            h[j] = np.maximum(0.0, h[j] + (cross[j] - a[j] @ h) / a[j, j])
    return h


def improved_in_tasks(sums: DataFrame, h: np.ndarray, a: np.ndarray, inner: int) -> np.ndarray:
    """`improved`, block by block where the sums are. Only the new components come to the driver, in single
    precision (which is then what they are), and zeros are left out where that is shorter."""
    k, width = h.shape
    rows_each = rows_in_block(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, numbers in zip(batch.column(0).to_pylist(), batch.column(1)):
                old = h[:, block * rows_each:(block + 1) * rows_each]
                cross = numbers.values.to_numpy().reshape(rows_each, k).T[:, :old.shape[1]]
                new = improved(old, cross, a, inner).T.ravel().astype(np.float32)
                kept = np.flatnonzero(new)
                sparse = k <= BLOCK and 6 * len(kept) < 4 * len(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([kept.astype(np.int16)] if sparse else [None], pa.list_(pa.int16())),
                     pa.array([new[kept] if sparse else new], pa.list_(pa.float32()))], names=["block", "place", "number"])

    got = sums.mapInArrow(run, "block int, place array<smallint>, number array<float>").toArrow()
    out = [None] * -(-width // rows_each)
    for block, place, number in zip(got.column("block").to_pylist(), got.column("place"), got.column("number")):
        own = slice(block * rows_each, min((block + 1) * rows_each, width))
        new = np.zeros((own.stop - own.start) * k)
        new[slice(None) if not place.is_valid else place.values.to_numpy()] = number.values.to_numpy()
        out[block] = new.reshape(-1, k).T
    for block, new in enumerate(out):
        if new is None:  # terms that no weight has met
            old = h[:, block * rows_each:(block + 1) * rows_each]
            out[block] = improved(old, np.zeros_like(old), a, inner).astype(np.float32).astype(np.float64)
    return np.concatenate(out, axis=1)


def save_matrix(spark: SparkSession, m: np.ndarray, path: str) -> None:
    """A bounded matrix as rows of a Parquet table."""
    spark.createDataFrame([(i, r) for i, r in enumerate(m.tolist())], "row int, vec array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("row").toArrow()
    width = len(rows.column("vec")[0]) if rows.num_rows else 0
    return rows.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, max(width, 1)) if rows.num_rows else np.zeros((0, 0))


# ---------------------------------------------------------------------------
# Text encoder (M8)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Encoder:
    """Text to unit vectors: TF-IDF terms projected on the leading singular vectors of the fitted corpus
    (latent semantic analysis), so that texts meet through words that keep the same company."""

    prep: PipelineModel
    projection: np.ndarray  # vocabulary x dims

    def encode(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """df with `out`, an ARRAY<DOUBLE> of length one; a text without known terms gets zeros."""
        projection = self.projection

        def project(rows: Rows) -> np.ndarray:
            x = rows.dot(projection)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            return x / np.where(norm > 0, norm, 1.0)

        cols = [c for c in df.columns if c != out]
        x = self.prep.transform(df.select(*cols, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")))
        return mapped(x.select(*cols, "features"), "features", out, project)

    def save(self, path: str) -> None:
        self.prep.write().overwrite().save(f"{path}/prep")
        save_matrix(SparkSession.active(), self.projection, f"{path}/projection")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Encoder":
        return Encoder(PipelineModel.load(f"{path}/prep"), load_matrix(spark, f"{path}/projection"))


def fit_encoder(df: DataFrame, text: str = "text", dims: int = 96, max_features: int = 1 << 15, passes: int = 4,
                stop_words=None, seed: int = 42) -> Encoder:
    """M8: TF-IDF over the most frequent `max_features` words that two texts share, then `dims` singular
    vectors. The vocabulary bounds what the driver and the tasks hold: max_features x (dims + 8) numbers."""
    from vocspark.operators.ml import fit_tfidf
    from vocspark.session import spread
    texts = written(spread(df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))))
    prep = fit_tfidf(texts, "_text", max_features, ngram=1, min_df=2.0, max_df=0.95, stop_words=stop_words)
    x = written(prep.transform(texts).select("features"))
    width = len(vocabulary(prep))
    v, _ = svd(x, width, dims, passes, seed)
    return Encoder(prep, v)


def vocabulary(prep: PipelineModel) -> list[str]:
    from pyspark.ml.feature import CountVectorizerModel
    return next(s for s in prep.stages if isinstance(s, CountVectorizerModel)).vocabulary


def phrase_centroids(encoder: Encoder, phrases: dict[str, list[str]], key: str = "category") -> DataFrame:
    """M9: one unit centroid for each label: the mean of its phrases' vectors. Phrases without known
    words count as zeros. Bounded by the taxonomy (a few dozen phrases)."""
    from vocspark.operators.vectors import centroids
    spark = SparkSession.active()
    rows = [(label, p) for label, own in phrases.items() for p in own]
    return centroids(encoder.encode(spark.createDataFrame(rows, f"{key} string, phrase string"), "phrase"), key, "embedding")


def classify_text(df: DataFrame, text: str, encoder: Encoder, cents: DataFrame, key: str = "category",
                  threshold: float | None = None, fallback: str | None = None) -> DataFrame:
    """M8 + M10: encodes a text column and adds best_label, confidence and predicted (below the threshold:
    the fallback)."""
    from vocspark import config as C
    from vocspark.operators.vectors import classify
    x = classify(encoder.encode(df, text, "_vec"), "_vec", cents, key,
                 threshold=C.CONFIDENCE_THRESHOLD if threshold is None else threshold, fallback=fallback or C.FALLBACK_LABEL)
    return x.drop("_vec")


def label_keywords(df: DataFrame, keywords: str, encoder: Encoder, cents: DataFrame, out: str = "label") -> DataFrame:
    """the issue label of a keyword string; the fallback below the label threshold or without keywords."""
    from vocspark import config as C
    cols = [c for c in df.columns if c != out]
    x = classify_text(df, keywords, encoder, cents, threshold=C.LABEL_THRESHOLD)
    return x.select(*cols, F.col("predicted").alias(out))

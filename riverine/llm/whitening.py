"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverine.llm.shared import written

#: Entries c become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries up to which the integers above are exact in what follows.
LARGEST = 2.0**40
_EXACT = 2.0**53


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps.

    Its eigenvalues are the signs of those of the matrix. The weights suit singular values down to 1e-16 of the largest.
    """
    n = len(a)
    x, low = a / np.linalg.norm(a), 1e-16
    for _ in range(20):
        sq = low * low
        d = (4 * (1 - sq) / (sq * sq)) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - sq) / (sq * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        if moved <= 1e-15 * np.sqrt(n) or (low == 1.0 and moved <= 1e-10):
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of eigenvalues above and below the shift; None if they don't come apart."""
    n, rng = len(a), np.random.default_rng(12)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < n:
        return None
    basis = rng.standard_normal((n, rank))
    for _ in range(3):  # subspace iteration; the projector's other eigenvalues are 0, so it settles at once
        q, _ = np.linalg.qr(projector @ basis, mode="complete")
        basis = q[:, :rank]
    return q[:, :rank], q[:, rank:]


def leading_components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    A polar decomposition of the matrix, shifted by its mean eigenvalue, gives the projector on the eigenvalues above the
    shift. Both invariant subspaces are split again until they have one dimension; those below what is asked for are
    left. Equal eigenvalues end the splitting: any basis of theirs will do.
    """
    n, size = len(a), np.linalg.norm(a)
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n)) if n else 0.0
    if n == 0 or spread <= 4 * n * np.finfo(float).eps * size:
        return np.diag(a)[:most].copy(), np.eye(n)[:, :most]
    best, parts = np.inf, None
    for nudge in (0.0, 0.1, -0.1, 0.23, -0.23):  # an eigenvalue may lie at the shift
        found = _halves(a, np.trace(a) / n + nudge * spread / np.sqrt(n))
        if found is None:
            continue
        rest = np.linalg.norm(found[1].T @ a @ found[0])
        if rest < best:
            best, parts = rest, found
        if rest <= 16 * n * np.finfo(float).eps * size:
            break
    if parts is None:
        return np.sort(np.diag(a))[::-1][:most], np.eye(n)[:, np.argsort(-np.diag(a), kind="stable")[:most]]
    values, vectors = [], []
    for basis in parts:
        if (left := most - sum(map(len, values))) > 0:
            inner = basis.T @ a @ basis
            e, v = leading_components((inner + inner.T) / 2, left)
            values.append(e)
            vectors.append(basis @ v)
    e, v = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact y.T @ y, as 64-bit integers where they hold it."""
    top = float(np.abs(y).max(initial=0)) ** 2 * len(y)
    if top < _EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64)
    return y.T @ y if top < 2.0**63 else y.astype(object).T @ y.astype(object)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, of the rows whose vector is not null and holds only finite entries."""
    good = "forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    named = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(f"v IS NOT NULL AND {good}")
    whole = f"IF(abs(c) <= {LARGEST}D, floor({SCALE} * c) + {SHIFT}L, raise_error('an entry is beyond 2^40'))"
    return named.selectExpr("vec_id", f"transform(v, c -> cast({whole} AS bigint)) AS x")


class Whitening:
    """Mean and components of a fit list: what whitens any row of integers."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.trace = n, sums, trace
        self.values, self.components = values, vectors
        positive = values > np.finfo(float).eps * max(trace, 0.0) * len(sums)
        self.with_variance = positive
        self.matrix = vectors / np.sqrt(np.where(positive, values, 1.0)) / n

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        top = max(float(np.abs(x).max(initial=0)) * self.n, float(np.abs(self.sums.astype(float)).max(initial=0)))
        if top < 2.0**62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def white(self, scaled: np.ndarray) -> np.ndarray:
        """A row's coordinates, one a component; NaN where a component has no variance."""
        out = scaled.astype(np.float64) @ self.matrix
        out[:, ~self.with_variance] = np.nan
        return out

    def deviations(self, scaled: np.ndarray) -> pa.Array:
        """Sums of squares of each row, exactly; null beyond 64 bits."""
        top = float(np.abs(scaled).max(initial=0)) ** 2 * scaled.shape[1]
        if top < 2.0**62:
            return pa.array((scaled.astype(np.int64) ** 2).sum(axis=1), pa.int64())
        return pa.array([v if v < 2**63 else None for v in (scaled.astype(object) ** 2).sum(axis=1)], pa.int64())


def fit_whitening(fit: DataFrame, most: int) -> Whitening | None:
    """Components of distinct integer vectors x of one length; None without any.

    Sums and products of integers, centred by the rounded mean before multiplying, are added up exactly on Spark, so the
    covariance is correct to the last bit. What reaches the driver is a matrix of dimension by dimension.
    """
    sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    if not sums:
        return None
    n, s = sums[0].n, np.array([r.s for r in sums], object)
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = _gram(_matrix(b.column("x")) - centre).astype(object)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(centre))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in total[i, j]])], ["i", "j", "s"])

    cells = fit.mapInArrow(partial, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    d = len(s)
    rest = s - n * centre.astype(object)  # sums of what was multiplied
    v = np.zeros((d, d))
    for c in cells:
        v[c.i, c.j] = v[c.j, c.i] = (n * int(c.s) - rest[c.i] * rest[c.j]) / (n * n)  # exact integers until they are divided
    values, vectors = leading_components(v, min(most, d))
    return Whitening(n, s, values, vectors, float(np.trace(v)))


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest entry, in size, of the whitened fit list's covariance minus the identity, from its rows."""
    shared, use = fit.sparkSession.sparkContext.broadcast(w), np.flatnonzero(w.with_variance)
    if not len(use):
        return 0.0
    k = len(use)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, total = shared.value, np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                z = one.white(one.scaled(_matrix(b.column("x"))))[:, use]
                total += np.vstack([z.sum(axis=0), z.T @ z])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((k + 1, k))
    for c in fit.mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[c.i, c.j] = c.s
    mean = total[0] / w.n
    return float(np.abs(total[1:] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null or an entry that isn't finite are dropped; so are those of another
    length than most have (of equal shares, the longest). Entries become integers floor(64 c) + 1000000; each distinct
    integer vector is fitted once. `whitened` is null, and left out of `identity_error`, for a component that has no
    variance (explained 0), as when all vectors are equal; vectors of fewer than `components` entries have as many
    components as entries. Equal eigenvalues take any orthonormal basis. Repeated rows and rows without an id come out
    each; `deviation` is null beyond 64 bits; an entry beyond 2^40 is an error; an empty table gives no rows; other
    columns aren't read. Fit list and components are found before it returns.
    """
    spark = table.sparkSession
    rows = integer_vectors(table, id_col, vector_col)
    kind = table.schema[id_col].dataType.simpleString()
    out = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = rows.select(F.size("x").alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], out)
    alike = rows.where(F.size("x") == lengths.d)
    fit = written(alike.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, components)
    error, shared = identity_error(fit, model), spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = len(w.values)
        share = w.values / w.trace if w.trace > 0 else np.zeros(k)
        share = np.where(w.with_variance, share, 0.0)
        for b in batches:
            if not b.num_rows:
                continue
            m = b.num_rows
            scaled = w.scaled(_matrix(b.column("x")))
            of = pa.array(np.repeat(np.arange(m), k))
            white = w.white(scaled).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    w.deviations(scaled).take(of), pa.array(white, mask=np.isnan(white)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return alike.mapInArrow(run, out)


"""Whitening embeddings by their leading principal components.

The covariance is gathered block by block where the vectors are; what reaches
the driver is one matrix of the vectors' dimension, whatever their number. Its
leading eigenpairs are found by Householder reflections to tridiagonal form,
bisection on Sturm counts and inverse iteration; eigenvectors of close values
are kept orthogonal to each other. The projection goes back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastline.llm.tables import cut
from mastline.llm.textarrays import lean
from mastline.llm.vectors import dimension, pack, rows_of, unpack, whole

COMPONENTS = 4
BLOCK = 4096
#: A component whose variance is below this share of the largest possible one has none: it is rounding.
LEAST = 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# -- the eigenproblem of one symmetric matrix --------------------------------------
def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors u with H = I - 2uu', such that
    H(d-2)...H(1) v H(1)...H(d-2) is tridiagonal."""
    a, reflectors = v.astype(float), []
    d = len(a)
    for k in range(d - 2):
        u = np.zeros(d)
        u[k + 1:] = a[k + 1:, k]
        u[k + 1] += np.copysign(np.linalg.norm(u), u[k + 1])
        norm = np.linalg.norm(u)
        if norm > 0:
            u /= norm
            w = a @ u
            w -= (u @ w) * u
            a -= 2 * (np.outer(u, w) + np.outer(w, u))
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: number of eigenvalues below each ``x``."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off * off, initial=0.0)))
    q = diagonal[0] - x
    count = (q < 0).astype(int)
    for k in range(1, len(diagonal)):
        q = diagonal[k] - x - off[k - 1] ** 2 / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bracket has no inner number."""
    d = len(diagonal)
    reach = np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    pad = np.finfo(float).eps * d * max(abs(low[0]), abs(high[0]))
    low, high = low - pad, high + pad
    rank = d - np.arange(k)  # the j-th largest has fewer than rank values below it
    while True:
        mid = low + (high - low) / 2
        if not ((low < mid) & (mid < high)).any():
            return mid
        over = count_below(diagonal, off, mid) >= rank
        low, high = np.where(over, low, mid), np.where(over, mid, high)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift I) x = b by elimination with row exchanges; zero pivots become tiny ones."""
    d = len(diagonal)
    tiny = np.finfo(float).eps * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    main, up, up2 = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    x = b.astype(float).copy()
    for k in range(d - 1):
        below, right = off[k], main[k + 1]
        if abs(below) > abs(main[k]):
            factor = main[k] / below
            main[k], up[k], up2[k], main[k + 1], up[k + 1] = below, right, up[k + 1], up[k] - factor * right, -factor * up[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
        else:
            main[k] = main[k] or tiny
            factor = below / main[k]
            main[k + 1] = right - factor * up[k]
            x[k + 1] -= factor * x[k]
    main[-1] = main[-1] if abs(main[-1]) > tiny else tiny
    for k in range(d - 1, -1, -1):
        if k + 1 < d:
            x[k] -= up[k] * x[k + 1]
        if k + 2 < d:
            x[k] -= up2[k] * x[k + 2]
        x[k] /= main[k] if abs(main[k]) > tiny else tiny
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, as columns. Inverse iteration
    gives members of a cluster of values the same direction, so each step takes
    out what earlier members of the cluster have."""
    d, out, cluster = len(diagonal), [], []
    spread = 1e-3 * max(float(np.abs(diagonal).max()) + 2 * float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    for k, value in enumerate(values):
        if k and values[k - 1] - value > spread:
            cluster = []
        # Equal shifts would give equal vectors, so a repeated value is moved by rounding.
        shift = value - (len(cluster) * np.finfo(float).eps * max(abs(value), np.finfo(float).tiny) if cluster else 0.0)
        start = np.random.default_rng(7 + k).standard_normal(d)
        x = start / np.linalg.norm(start)
        for _ in range(6):
            x = _solve(diagonal, off, shift, x)
            x /= np.abs(x).max()
            for _ in range(2):
                for other in cluster:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        cluster.append(x)
        out.append(x)
    return np.array(out).T


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    k = min(k, len(v))
    scale = float(np.abs(v).max(initial=0.0))
    if not k or not scale:
        return np.zeros(k), np.eye(len(v))[:, :k]
    diagonal, off, reflectors = tridiagonal(v / scale)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for u in reversed(reflectors):
        vectors -= 2 * np.outer(u, u @ vectors)
    return values * scale, vectors


# -- the vectors ----------------------------------------------------------------
def fit_list(rows: DataFrame, dim: int) -> DataFrame:
    """Each distinct vector once, as bytes; copies are combined before the shuffle."""
    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([pack(whole(batch.column(0), dim)[1])], names=["x"])

    return rows.select("embedding").mapInArrow(packed, "x binary").distinct()


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number and exact per-dimension sums: a row per task and dimension is added up."""
    @lean
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in rows_of(batches, 1 << 9):  # 512 entries within the bound stay below 2**63
            n += batch.num_rows
            total += unpack(batch.column(0), dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([str(t) for t in total]), pa.array(np.full(dim, n))], names=["i", "s", "n"])

    found = fit.mapInArrow(partial, "i long, s string, n long").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (found[0].n, [int(r.s) for r in found]) if found else (0, [0] * dim)


def covariance(fit: DataFrame, dim: int, mean: np.ndarray, n: int) -> np.ndarray:
    """Divisor n; every vector is centred before it is multiplied. A task gives one matrix, by rows."""
    @lean
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in rows_of(batches, BLOCK):
            y = unpack(batch.column(0), dim) - mean
            total += y.T @ y
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((dim, dim))
    for r in fit.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def _project(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes


def identity_error(fit: DataFrame, dim: int, mean: np.ndarray, axes: np.ndarray) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    k = axes.shape[1]

    @lean
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BLOCK):
            w = _project(unpack(batch.column(0), dim), mean, axes)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, c])) for c in range(k)], names=[f"w{c}" for c in range(k)])

    rows = fit.mapInArrow(projected, ", ".join(f"w{c} double" for c in range(k)))
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = rows.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray, largest: int) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; null where it is no 64-bit number."""
    reach = n * int(np.abs(x).max(initial=0)) + largest
    if reach * reach * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and leading component: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Vectors that are null, or hold null or non-finite entries, take no part; nor do
    vectors of another length than the most common one. Entries become
    floor(256 * c), held within 2**53. The components are fitted on each distinct
    vector once, so copies weigh nothing; all rows, copies and rows with a null
    vec_id included, are projected. Components without variance are left out: a
    table of one vector has no rows. ``deviation`` is null where the exact value
    exceeds 64 bits. Other columns play no part, whatever their names.

    The driver holds a few matrices of the vectors' dimension.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dim = dimension(rows)
    nothing = rows.sparkSession.createDataFrame([], OUT)
    if not dim:
        return nothing
    fit = cut(fit_list(rows, dim), "fit-list")
    n, totals = _sums(fit, dim)
    sums = np.array(totals, object)
    mean = np.array([s / n for s in totals])
    v = covariance(fit, dim, mean, n)
    values, vectors = leading(v, components)
    kept = values > LEAST * max(float(np.trace(v)), np.finfo(float).tiny)
    values, vectors = values[kept], vectors[:, kept]
    if not len(values):
        return nothing
    axes = vectors / np.sqrt(values)
    explained = values / np.trace(v)
    error = identity_error(fit, dim, mean, axes)
    k, largest = len(values), max(map(abs, totals))

    @lean
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BLOCK):
            at, x = whole(batch.column(1), dim)
            dev = _deviations(x, n, sums, largest)
            ids = batch.column(0).take(pa.array(at)).take(pa.array(np.repeat(np.arange(len(at)), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(k * len(at), n)),
                pa.array([d for d in dev for _ in range(k)], pa.int64()), pa.array(_project(x, mean, axes).ravel()),
                pa.array(np.tile(explained, len(at))), pa.array(np.full(k * len(at), error))], names=[f.split()[0] for f in OUT.split(", ")])

    return rows.mapInArrow(projected, OUT)

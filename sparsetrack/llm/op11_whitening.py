"""Whitening of embeddings by their leading principal components.

An entry c becomes x = floor(64 c) + 1000000; statistics are over each distinct x vector once.  Tasks sum the distinct vectors
(exactly), then, around the mean, the products of their components; sums meet by row of the matrix.  What reaches the driver
is a matrix of d x d for vectors of length d, however many there are.  There it is brought to tridiagonal form by Householder
reflections; the ``K`` largest eigenvalues are bracketed by Sturm counts and bisected to the last bit; inverse iteration
finds their vectors, and within a cluster of close eigenvalues each is made orthogonal to those before.  Reflected back, the
components go to all tasks (d x K numbers), which project every row.  A last pass over the distinct vectors measures the
covariance of the result.

Centring is exact up to one rounding: x less the whole part of the mean is an integer, from which the mean's fraction goes.

Rows whose vector is null, empty, or holds null or non-finite entries are left out; nothing else is.  Vectors of each length
are a population of their own.  Entries beyond 2**38 in size count as 2**38 (so that sums are exact).  ``deviation`` is null
where it doesn't fit a long.  Components whose eigenvalue is below ``FLAT`` of the largest, all of them if all vectors are
equal, don't exist and have no rows.  A component's sign is that of its first largest entry.  Repeated rows and rows without
vec_id get their rows each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, enter, record, small_batches, written

K, SCALE, OFFSET, REACH, FLAT, CLUSTER = 16, 64, 1_000_000, 2.0**38, 1e-11, 1e-3
PARTIAL_SQL = "d int, i int, row array<double>"
PARTIAL = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])


# --- symmetric eigenproblem, on one small matrix ---------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflection vectors (k-th from place k + 1 on) of Householder's reduction."""
    a, reflections = matrix.astype(np.float64).copy(), []
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt((v * v).sum())
        if length == 0 or not v[1:].any():
            reflections.append(np.zeros(n - k - 1))
            continue
        alpha = -np.copysign(length, v[0])
        v[0] -= alpha
        v /= np.sqrt((v * v).sum())
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each place."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    squares = np.append(0.0, off * off)
    for d, s in zip(diagonal, squares, strict=True):
        q = d - at - s / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of Gershgorin's interval."""
    n = len(diagonal)
    around = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    rank = n - 1 - np.arange(k)  # eigenvalues below the one sought
    lo, hi = np.full(k, (diagonal - around).min()), np.full(k, (diagonal + around).max())
    pad = np.finfo(float).eps * max(abs(lo[0]), abs(hi[0])) * n + np.finfo(float).tiny
    lo, hi = lo - pad, hi + pad
    while True:
        middle = lo + (hi - lo) / 2
        if ((middle <= lo) | (middle >= hi)).all():
            return middle
        less = below(diagonal, off, middle) <= rank
        lo, hi = np.where(less, middle, lo), np.where(less, hi, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, scale: float) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges; pivots of 0 become tiny."""
    n = len(diagonal)
    u0, u1, u2, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        below_, next_, after = off[i], u0[i + 1], u1[i + 1]
        if abs(below_) > abs(u0[i]):
            m = u0[i] / below_
            u0[i + 1], u1[i + 1] = u1[i] - m * next_, -m * after
            u0[i], u1[i], u2[i] = below_, next_, after
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
        else:
            if u0[i] == 0:
                u0[i] = scale
            m = below_ / u0[i]
            u0[i + 1] = next_ - m * u1[i]
            x[i + 1] -= m * x[i]
    if u0[-1] == 0:
        u0[-1] = scale
    for i in range(n - 1, -1, -1):
        s = x[i] - (u1[i] * x[i + 1] if i + 1 < n else 0.0) - (u2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = s / u0[i]
        if abs(x[i]) > 1e150:  # its direction is all that counts
            x *= 1e-150
    return x


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those of close eigenvalues are made orthogonal to one another."""
    n, eps = len(diagonal), np.finfo(float).eps
    size = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny)
    out, cluster, before = np.zeros((n, len(values))), 0, np.inf
    random = np.random.default_rng(11)
    for j, value in enumerate(values):
        if j == 0 or values[j - 1] - value > CLUSTER * size:
            cluster = j
        shift = min(value, before - 10 * eps * size) if j > cluster else value
        before = shift
        x = random.standard_normal(n)
        for _ in range(6):
            x = _solve(diagonal, off, shift, x, eps * size)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, cluster:j] @ (out[:, cluster:j].T @ x)
            x /= np.sqrt((x * x).sum())
        out[:, j] = x
    return out


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues, falling, and their unit eigenvectors as columns, without those that are next to nothing."""
    k = min(k, len(matrix))
    size = np.abs(matrix).max(initial=0.0)
    if size == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = leading(diagonal, off, k)
    values = values[values > FLAT * values[0]]
    found = vectors(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        found[i + 1 :] -= 2 * np.outer(v, v @ found[i + 1 :])
    found /= np.sqrt((found * found).sum(axis=0))
    found *= np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1.0, 1.0)
    return values * size, found


# --- passes over the vectors -----------------------------------------------------------------------------------------


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of a column of vectors."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[starts[at][:, None] + np.arange(d)]


def _column(batch: pa.RecordBatch, name: str) -> pa.ListArray:
    c = batch.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task's vectors, and their number: (d, i, s), the number under i = -1."""
    sums: dict[int, list[int]] = {}
    for b in it:
        for d, _, x in _by_length(_column(b, "x")):
            have = sums.setdefault(d, [0] * (d + 1))
            for i, s in enumerate([len(x), *x.sum(axis=0).tolist()]):
                have[i] += s
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("s", pa.decimal128(38, 0))])
    rows = [(d, i - 1, Decimal(s)) for d, all_ in sums.items() for i, s in enumerate(all_)]
    yield record(schema, zip(*rows, strict=True) if rows else [[]] * 3)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def _products(means: dict[int, tuple[int, list[int]]], projections: dict[int, np.ndarray] | None = None):
    """Sums of products of a task's centred (and projected) vectors: rows of a matrix."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("whitening")
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for d, _, x in _by_length(_column(b, "x")):
                y = centred(x, *means[d])
                y = y if projections is None else y @ projections[d]
                sums[d] = sums.get(d, 0) + y.T @ y
        rows = [(d, i, row) for d, m in sums.items() for i, row in enumerate(m)]
        yield record(PARTIAL, zip(*rows, strict=True) if rows else [[]] * 3)

    return run


def _added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same place in the matrix are added as they come."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in it:
        for d, i, row in zip(b.column("d").to_pylist(), b.column("i").to_pylist(), b.column("row"), strict=True):
            sums[d, i] = sums.get((d, i), 0) + row.values.to_numpy()
    rows = [(*key, row) for key, row in sums.items()]
    yield record(PARTIAL, zip(*rows, strict=True) if rows else [[]] * 3)


def matrices(partial: DataFrame) -> dict[int, np.ndarray]:
    """The sums of all tasks, by length: d rows of d numbers each."""
    out: dict[int, list] = {}
    for r in partial.repartition("d", "i").mapInArrow(_added, PARTIAL_SQL).collect():
        out.setdefault(r.d, []).append((r.i, r.row))
    return {d: np.array([row for _, row in sorted(rows)]) for d, rows in out.items()}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)**2, exactly; None beyond 64 bits."""
    far = float(np.abs(n * x.astype(np.float64) - np.array(sums, np.float64)).max(initial=0))
    if x.shape[1] * far * far < 2.0**62 and n * float(np.abs(x).max(initial=0)) < 2.0**62 and all(abs(s) < 2**62 for s in sums):
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whiten(vectors_: DataFrame, k: int = K) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    spark = vectors_.sparkSession
    small_batches(spark)
    scaled = lambda c: F.greatest(F.least(c.cast("double"), F.lit(REACH)), F.lit(-REACH)) * SCALE
    sound = vectors_.select(vectors_["vec_id"].cast("long").alias("vec_id"), vectors_["embedding"].alias("e"))
    sound = sound.where((F.size("e") > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    rows = sound.select("vec_id", F.transform("e", lambda c: F.floor(scaled(c)) + OFFSET).alias("x"))
    fit = written(rows.select("x").distinct(), "distinct")
    means: dict[int, tuple[int, list[int]]] = {}
    facts = fit.mapInArrow(_sums, "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").alias("s"))
    for r in sorted(facts.collect()):  # d + 1 numbers for each length
        n, sums = means.get(r.d, (0, []))
        means[r.d] = (int(r.s), sums) if r.i < 0 else (n, [*sums, int(r.s)])
    models: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d, m in matrices(fit.mapInArrow(_products(means), PARTIAL_SQL)).items():
        v = m / means[d][0]
        values, found = components((v + v.T) / 2, k)
        models[d] = found / np.sqrt(values), values / np.trace(v) if len(values) else values
    projections = {d: p for d, (p, _) in models.items()}
    errors = {d: float(np.abs(m / means[d][0] - np.eye(len(m))).max()) for d, m in matrices(fit.mapInArrow(_products(means, projections), PARTIAL_SQL)).items() if len(m)}
    discard(fit)
    error = max(errors.values(), default=0.0)
    model = spark.sparkContext.broadcast((means, models))
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("whitening")
        means, models = model.value
        for b in it:
            ids = b.column("vec_id").to_pylist()
            for d, at, x in _by_length(_column(b, "x")):
                (n, sums), (projection, explained) = means[d], models[d]
                y = centred(x, n, sums) @ projection
                count, many = y.shape
                if many:
                    each = lambda v: [v[i] for i in range(count) for _ in range(many)]  # noqa: B023, E731
                    yield record(schema, (each([ids[i] for i in at]), np.tile(np.arange(1, many + 1, dtype=np.int32), count), np.full(count * many, n), each(deviations(x, n, sums)), y.ravel(), np.tile(explained, count), np.full(count * many, error)))

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

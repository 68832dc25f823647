"""Nearest neighbours by collision counting on query-aware single projections.

Every block of vectors is indexed, once, by ``PROJECTIONS`` sorted arrays of its projections on random directions.  A query's
window opens around its own projection in all arrays at once and widens by a constant factor (virtual rehashing: a wider
window is only the old one and what it gains on either side).  A vector met in at least the share ``ALPHA`` of the arrays has
collided often enough and is verified by its exact distance.  Widening ends when anything nearer than the k-th best found
would have collided often enough with great probability, or when all is verified.

Wide windows tell near from far best, and most entries lie in them.  So the first window is guessed from the distances to
``PROBE`` vectors of the block, and its collisions are counted by what lies outside, the shorter ends of the arrays.

Every row is indexed.  Queries are a stated set: they are written to the shared folder in files of ``QUERY_BLOCK``, and each
task reads them file by file for the blocks it holds, so one job and one pass over the vectors serve all queries, and nothing
of them passes the driver.  Of a block only each query's k nearest come back, so the last ranking sees k rows for each block
and query.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without vec_id, take no part; vectors
of another length than the query's are no candidates.  A query isn't its own candidate, nor are other rows with its id.
Should a query's id repeat with different vectors, the smallest vector asks.  Ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_dir, record, small_batches

K, EVERY = 10, 100
PROJECTIONS, ALPHA, SURE, WIDEN, PROBE, BLOCK, QUERY_BLOCK = 128, 0.9, 0.5, 1.03, 256, 20_000, 2_000
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_SQL = "query_id long, vec_id long, score double"


def usable(values: list | np.ndarray | None) -> np.ndarray | None:
    if values is None or len(values) == 0:
        return None
    x = np.array([np.nan if v is None else v for v in values], np.float64) if not isinstance(values, np.ndarray) else values.astype(np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _likely(distance: float, half: float, m: int) -> bool:
    """Whether a vector at ``distance`` reaches ALPHA of m windows of this half width, SURE standard deviations off."""
    if distance == 0:
        return True
    p = math.erf(half / distance / math.sqrt(2))
    return p - SURE * math.sqrt(p * (1 - p) / m) >= ALPHA


class Arrays:
    """Sorted projections of a block; one search serves all arrays, which lie behind each other."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int, seed: int = 7):
        self.ids, self.vectors, self.m = ids, vectors, m
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], m))
        projected = np.ascontiguousarray((vectors @ self.directions).T)
        order = np.argsort(projected, axis=1, kind="stable")
        ranked = np.take_along_axis(projected, order, axis=1)
        self.reach = 4 * (float(np.abs(ranked).max()) + 1)
        self.base = np.arange(m) * self.reach
        self.flat, self.order = (ranked + self.base[:, None]).ravel(), order.ravel()
        self.probe = vectors[:: max(1, len(vectors) // PROBE)]

    def _ends(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows begin and end; one beyond the block's reach holds a whole array and nothing of the next."""
        lo, hi = (np.clip(x, -self.reach / 2, self.reach / 2) + self.base for x in (at - half, at + half))
        return self.flat.searchsorted(lo), self.flat.searchsorted(hi, "right")

    def _met(self, *ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        parts = [self.order[a:b] for lo, hi in ranges for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return np.bincount(np.concatenate(parts), minlength=len(self.ids))

    def nearest(self, q_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the nearest found, and how many vectors were verified."""
        at = q @ self.directions
        near = np.sqrt(((self.probe - q) ** 2).sum(axis=1))
        half = 1.9 * max(0.9 * float(near.min()), 0.3 * float(np.median(near)), 1e-9)
        own = self.ids == q_id
        seen, need = own.copy(), math.ceil(ALPHA * self.m)
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        lo, hi = self._ends(at, half)
        bounds = np.arange(self.m + 1) * len(self.ids)
        count = self.m - self._met((bounds[:-1], lo), (hi, bounds[1:]))
        while True:
            new = np.flatnonzero((count >= need) & ~seen)
            if len(new):
                seen[new] = True
                # summed from the first component to the last
                d = np.sqrt(np.add.accumulate((self.vectors[new] - q) ** 2, axis=1)[:, -1])
                best_d, best_i = np.concatenate((best_d, d)), np.concatenate((best_i, self.ids[new]))
                top = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[top], best_i[top]
            if seen.all() or (len(best_d) == k and _likely(best_d[-1], half, self.m)):
                return best_i, best_d, int(seen.sum() - own.sum())
            half *= WIDEN
            while len(best_d) == k and not _likely(best_d[-1], half, self.m):  # as wide as the present k-th asks for
                half *= WIDEN
            a, b = self._ends(at, half)
            count += self._met((a, lo), (hi, b))
            lo, hi = a, b


def _asked(path: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The queries of one file after the other."""
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    for f in sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.path.endswith(".parquet")):
        table = pyarrow.parquet.read_table(f, filesystem=fs, partitioning=None)
        yield [(i, v.values.to_numpy()) for i, v in zip(table.column("vec_id").to_pylist(), table.column("embedding"), strict=True)]


def _search(path: str, k: int, m: int, block: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def work(rows):
            index = Arrays(np.array([r[0] for r in rows], np.int64), np.stack([r[1] for r in rows]), m)
            for asked in _asked(path):
                out = []
                for q_id, q in asked:
                    if len(q) == index.vectors.shape[1]:
                        ids, d, _ = index.nearest(q_id, q, k)
                        out += zip([q_id] * len(ids), ids.tolist(), d.tolist(), strict=True)
                yield record(FOUND, zip(*out, strict=True) if out else [[]] * 3)

        for b in it:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                x = usable(v.values.to_numpy(zero_copy_only=False) if v.is_valid else None)
                if i is None or x is None:
                    continue
                rows = held.setdefault(len(x), [])
                rows.append((i, x))
                if len(rows) >= block:
                    yield from work(rows)
                    held[len(x)] = []
        for rows in held.values():
            if rows:
                yield from work(rows)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, m: int = PROJECTIONS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query its k nearest rows found: query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    small_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    asked = queries.select(queries["vec_id"].cast("long").alias("vec_id"), queries["embedding"].cast("array<double>").alias("embedding")).where("vec_id is not null")
    sound = asked.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0))
    once = sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    path = fresh_dir(spark, "queries")
    once.write.option("maxRecordsPerFile", query_block).parquet(path)
    found = rows.mapInArrow(_search(path, k, m, block), FOUND_SQL)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op5_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))

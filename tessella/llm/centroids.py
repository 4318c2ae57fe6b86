"""Clusters round centroids, exactly as plain rounds of assigning and averaging give them, with Drake's adaptive bounds.

Each vector carries an upper bound of the distance to its own centroid, lower bounds for the several centroids that
were nearest to it apart from that one, in order, and one remainder bound for all others. When the centroids have moved,
each bound gives way by that centroid's move, the remainder by the largest. Then

* a vector whose upper bound lies below all its lower bounds keeps its centroid without any distance;
* else its own distance is computed, and the smallest number z is sought for which that distance lies below all bounds after
  the z nearest: only those z distances are computed, and the z + 1 centroids put in order again;
* where no z will do, the order cannot be certified, and the vector is compared with every centroid anew.

The number of bounds starts at a quarter of the centroids and falls to what the vectors needed, but not below an eighth. Distances are
exact integers, bounds are kept apart from them by a margin wider than rounding, and only a bound that is strictly
larger excludes a centroid, so ties go to the smaller number as in the plain method.

Each round is one pass over a table in the shared folder that holds the vectors with their bounds, and one aggregate
of its clusters' sums that combines within each task. Only the centroids, ``k`` vectors, pass through the driver.

Defined results. Entries x become floor(256 * x); rows whose vector is null, has other than ``dims`` entries, or a null, NaN
or infinite one, are left out. Entries beyond 64 bits are the nearest 64-bit number; entries of 2**21 and more are computed
with slower arithmetic, as exactly. Distances and their sums are null where they need more than 64 bits. Centroids start
as the ``k`` vectors with the smallest hash of their id (a null id hashes as an empty string; rows that share an id are
ordered by their entries); fewer vectors than ``k`` make as many centroids. Repeated rows are vectors of their own; the other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import forget, ready, written
from tessella.llm.whitening import integer_vectors

K, ROUNDS, DIMS, SEED = 40, 5, 64, 2
#: Bounds give way by this share of themselves, far more than rounding does.
MARGIN = 1e-9
#: Entries below this keep squared distances of up to 256 dimensions exact in doubles.
EXACT = 1 << 21


def seeds(rows: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.x) for r in rows.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()]


# -- distances and bounds


def _plain(*arrays: np.ndarray) -> bool:
    return all(a.dtype != object and (not a.size or max(-int(a.min()), int(a.max())) < EXACT) and a.shape[-1] <= 256 for a in arrays)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of x and those of c; doubles that hold integers, or Python's integers."""
    if _plain(x, c):
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def squared_each(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same between rows of one number."""
    if _plain(x, c):
        d = (x - c).astype(np.float64)
        return np.einsum("ij,ij->i", d, d)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Bounds:
    """cluster, upper, near (rows x b centroids), lower (their bounds), rest, and used: the bounds each row needed."""

    def __init__(self, cluster, upper, near, lower, rest):
        self.cluster, self.upper, self.near, self.lower, self.rest = cluster, upper, near, lower, rest
        self.used = np.zeros(len(cluster), np.int32)

    @classmethod
    def scanned(cls, x: np.ndarray, c: np.ndarray, b: int) -> Bounds:
        """From all distances. Ties are ordered by the centroid's number."""
        d = squared(x, c)
        order = np.argsort(d, axis=1, kind="stable")[:, : b + 2].astype(np.int32)
        root = _roots(np.take_along_axis(d, order, 1))
        rest = root[:, b + 1] * (1 - MARGIN) if len(c) > b + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0].copy(), root[:, 0] * (1 + MARGIN), order[:, 1 : b + 1].copy(), root[:, 1 : b + 1] * (1 - MARGIN), rest)

    def moved(self, by: np.ndarray, b: int) -> None:
        """The centroids have moved by so much; keep b bounds, the rest of them joins the remainder."""
        self.upper = (self.upper + by[self.cluster]) * (1 + MARGIN)
        if self.near.shape[1]:
            self.lower = (self.lower - by[self.near]) * (1 - MARGIN)
        self.rest = (self.rest - by.max()) * (1 - MARGIN)
        if self.near.shape[1] > b:
            self.rest = np.minimum(self.rest, self.lower[:, b:].min(axis=1))
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]

    def settle(self, x: np.ndarray, c: np.ndarray) -> int:
        """Assign every row exactly; how many were compared with all centroids."""
        b = self.near.shape[1]
        after = np.column_stack([self.lower, self.rest])  # after[:, z]: the least bound of all but the z nearest
        after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(~(self.upper < after[:, 0]))
        self.upper[open_] = _roots(squared_each(x[open_], c[self.cluster[open_]])) * (1 + MARGIN)
        sure = self.upper[open_, None] < after[open_]
        z = np.where(sure.any(axis=1), sure.argmax(axis=1), b + 1)
        self.used[open_] = np.minimum(z, b)
        for n in range(1, b + 1):
            rows = open_[z == n]
            if len(rows):
                ids = np.column_stack([self.cluster[rows], self.near[rows, :n]])
                d = np.column_stack([squared_each(x[rows], c[ids[:, k]]) for k in range(n + 1)])
                by_id = np.argsort(ids, axis=1)
                ids, d = np.take_along_axis(ids, by_id, 1), np.take_along_axis(d, by_id, 1)
                order = np.argsort(d, axis=1, kind="stable")
                ids, root = np.take_along_axis(ids, order, 1), _roots(np.take_along_axis(d, order, 1))
                self.cluster[rows], self.upper[rows] = ids[:, 0], root[:, 0] * (1 + MARGIN)
                self.near[rows, :n], self.lower[rows, :n] = ids[:, 1:], root[:, 1:] * (1 - MARGIN)
        rows = open_[z == b + 1]
        if len(rows):
            new = Bounds.scanned(x[rows], c, b)
            self.cluster[rows], self.upper[rows], self.near[rows], self.lower[rows], self.rest[rows] = new.cluster, new.upper, new.near, new.lower, new.rest
        return len(rows)


# -- passes over the table

_STATE = "cluster int, upper double, near array<int>, lower array<double>, rest double, used int, distance bigint"


def _matrix(column: pa.Array, n: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def _pass(rows: DataFrame, centroids: np.ndarray, b: int, before: tuple[int, np.ndarray] | None, last: bool) -> DataFrame:
    """``rows`` with new bounds. before: how many bounds they carry, and the centroids' moves since; None: they carry none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("x"), n, centroids.shape[1])
            if before is None:
                now = Bounds.scanned(x, centroids, b)
            else:
                had, moves = before
                get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
                now = Bounds(get("cluster"), get("upper"), _matrix(batch.column("near"), n, had).copy(), _matrix(batch.column("lower"), n, had).copy(), get("rest"))
                now.moved(moves, b)
                now.settle(x, centroids)
            far = [None] * n
            if last:
                far = [v if v < 1 << 63 else None for v in map(int, squared_each(x, centroids[now.cluster]))]
            cols = [batch.column("id"), batch.column("x"), pa.array(now.cluster, pa.int32()), pa.array(now.upper), _lists(now.near, pa.int32()), _lists(now.lower, pa.float64()), pa.array(now.rest), pa.array(now.used), pa.array(far, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "x", "cluster", "upper", "near", "lower", "rest", "used", "distance"])

    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, x array<bigint>, {_STATE}")


def _means(state: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], int]:
    """Exact floors of the clusters' means (an empty cluster stays), and the most bounds that a row needed."""
    entries = state.select("cluster", "used", F.posexplode("x").alias("pos", "v"))
    total = entries.groupBy("cluster", "pos").agg(F.expr("try_sum(v)").alias("s"), F.count(F.lit(1)).alias("n"), F.max("used").alias("used"))
    found = total.collect()  # k * dims rows
    if any(r.s is None for r in found):
        found = entries.groupBy("cluster", "pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"), F.max("used").alias("used")).collect()
    out = [list(c) for c in centroids]
    for r in found:
        out[r.cluster][r.pos] = int(r.s) // r.n
    return out, max(r.used for r in found)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """One row per vector that stays: id, cluster int, distance long (squared), cluster_inertia and inertia long, and
    centroid array<bigint>, its final centroid."""
    spark = vectors.sparkSession
    ready(spark)
    rows = written(integer_vectors(vectors.where(F.size(vec_col) == dims), id_col, vec_col).select("id", "x"), "vectors")
    centroids = seeds(rows, k, seed)
    if not centroids:
        return _result(rows.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long")), [[0] * dims])
    least = min(max(1, -(-k // 8)), len(centroids) - 1)
    b = min(max(least, k // 4), len(centroids) - 1)
    state = written(_pass(rows, np.array(centroids, np.int64), b, None, not rounds), "bounds")
    forget(rows)
    for r in range(rounds):
        means, used = _means(state, centroids)
        moves = np.array([sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) ** 0.5 for x, y in zip(centroids, means, strict=True)]) * (1 + MARGIN)
        centroids, had = means, b
        if r:
            b = min(b, max(least, used))
        after = written(_pass(state, np.array(centroids, np.int64), b, (had, moves), r == rounds - 1), "bounds")
        forget(state)
        state = after
    return _result(state, centroids)


def _result(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The clusters' figures, one row each and so ``k`` at most, come back to the rows by a broadcast."""
    whole = lambda x: F.when(F.count(x) == F.count(F.lit(1)), F.sum(x.cast("decimal(38,0)")))
    by = state.groupBy("cluster").agg(whole(F.col("distance")).alias("d"))
    got = {r.cluster: r.d for r in by.collect()}
    total = None if None in got.values() else sum(got.values())
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    facts = state.sparkSession.createDataFrame([(i, fits(got.get(i)), fits(total), c) for i, c in enumerate(centroids)], "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return state.select("id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """The digest of a centroid as the query gives it; for tests and callers that hold one."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()

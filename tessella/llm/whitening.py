"""Whitening of embeddings by hierarchical merging of singular value decompositions.

1. Each entry c becomes the integer floor(256 * c). The model is fitted to the distinct integer vectors, so that copies
   weigh nothing; equal vectors are brought together by an aggregate that combines within each task first.
2. Every task keeps one summary of the vectors it reads: their number, their exact sums, and all singular values with
   their right vectors (their product, one row a singular value: the root) of the vectors about their mean. Nothing is
   cut off, so ``root' @ root`` is the scatter matrix.
3. Two summaries merge by a decomposition of both roots on top of each other and one row more, the difference of the
   means times sqrt(na * nb / (na + nb)). Summaries merge in a tree of bounded fan-in, in tasks of their own; a
   summary has no more than dims rows whatever the number of vectors behind it.
4. The last root gives the eigenvectors and eigenvalues of the covariance. They are a few vectors a length, go to the rows
   by a broadcast whose size is checked (beyond it by a join that deals out hot lengths), and are applied by DataFrame
   functions.
5. The covariance of the whitened fit list is measured in the same way and compared with the identity.

Defined results. Rows whose vector is null, or holds a null, NaN or infinite entry, are left out; so are empty vectors,
which have no components. Vectors of different lengths lie in spaces of their own: each length has its own n, sums and
components, at most as many as its dimensions. Entries beyond 64 bits are the nearest 64-bit number. ``deviation`` is
null where it needs more than 64 bits, ``sums`` where a sum does. A component without variance (fewer distinct vectors
than components, or constant entries) has whitened null and explained 0, and counts for no identity error; the error is null if no
component has variance. Components have the sign that makes their largest entry (the first of equals) positive. Repeated rows give one result each; the
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import forget, ready, salted, written

#: Components that are returned.
COMPONENTS = 4
#: Bytes of summaries that one task holds, and of the model that a broadcast may hold.
TASK_BYTES = 64 << 20
BROADCAST_BYTES = 32 << 20

_PARTS = "dims int, part bigint, n bigint, sums array<decimal(38,0)>, mean array<double>, root binary"
_MODEL = "dims int, n bigint, sums array<bigint>, mean array<double>, axes array<struct<component: int, axis: array<double>, scale: double, explained: double>>"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """row long, id, dims int, x array<bigint>: the rows whose vector has finite entries only."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c * 256.0).cast("bigint"))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.size(v).alias("dims"), x.alias("x"))


# -- summaries


@dataclass
class Summary:
    """Of n vectors: exact sums (None for vectors that aren't integers), mean, and the root of their scatter matrix."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    root: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Summary:
        n, sums = len(rows), None
        mean = rows.mean(axis=0) if rows.dtype.kind == "f" else None
        if mean is None:
            top = max(abs(int(rows.max())), abs(int(rows.min())))
            sums = [int(s) for s in rows.sum(axis=0, dtype=np.int64 if top * n < 1 << 62 else object)]
            mean = np.array([s / n for s in sums])
        return Summary(n, sums, mean, _root(rows - mean))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        correction = np.sqrt(self.n / n * other.n) * (other.mean - self.mean)
        root = _root(np.vstack([self.root, other.root, correction]))
        if self.sums is not None and other.sums is not None:
            sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
            return Summary(n, sums, np.array([s / n for s in sums]), root)
        return Summary(n, None, self.mean + (other.mean - self.mean) * (other.n / n), root)


def _root(rows: np.ndarray) -> np.ndarray:
    """All singular values times their right vectors; tall input is reduced by QR first."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def _packed(found: list[tuple[int, int, Summary]]) -> pa.RecordBatch:
    cols = [
        pa.array([dims for dims, _, _ in found], pa.int32()),
        pa.array([part for _, part, _ in found], pa.int64()),
        pa.array([s.n for _, _, s in found], pa.int64()),
        pa.array([None if s.sums is None else [Decimal(v) for v in s.sums] for _, _, s in found], pa.list_(pa.decimal128(38, 0))),
        pa.array([s.mean for _, _, s in found], pa.list_(pa.float64())),
        pa.array([s.root.astype("<f8").tobytes() for _, _, s in found], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["dims", "part", "n", "sums", "mean", "root"])


def _unpacked(row: dict) -> Summary:
    mean = np.array(row["mean"])
    return Summary(row["n"], None if row["sums"] is None else [int(v) for v in row["sums"]], mean, np.frombuffer(row["root"], "<f8").reshape(-1, len(mean)))


def _matrices(dims: pa.Array, x: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of each length in a batch, as a matrix."""
    if not len(dims):
        return
    values, lengths = x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())
    keys = dims.to_numpy()
    begin = np.cumsum(lengths) - lengths
    for key in np.unique(keys).tolist():
        own = np.flatnonzero(keys == key)
        size = int(lengths[own[0]])
        yield key, values[begin[own][:, None] + np.arange(size)]


def summaries(rows: DataFrame) -> DataFrame:
    """The summaries of the column ``x`` by the column ``dims``, one a task (or more, where many lengths would not fit)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, Summary] = {}
        for batch in batches:
            for dims, matrix in _matrices(batch.column("dims"), batch.column("x")):
                own = Summary.of(matrix)
                held[dims] = held[dims].merged(own) if dims in held else own
            if sum(s.root.nbytes for s in held.values()) > TASK_BYTES and len(held) > 1:
                yield _packed([(d, part, s) for d, s in held.items()])
                held = {}
        if held:
            yield _packed([(d, part, s) for d, s in held.items()])

    return rows.select("dims", "x").mapInArrow(work, _PARTS)


def merged(parts: DataFrame) -> DataFrame:
    """One summary a length, by a tree of merges."""

    def fold(table: pa.Table) -> pa.Table:
        out, dims, part = None, None, None
        for batch in table.to_batches(max_chunksize=1):
            row = batch.to_pylist()[0]
            dims, part = row["dims"], row["part"]
            out = _unpacked(row) if out is None else out.merged(_unpacked(row))
        return pa.Table.from_batches([_packed([(dims, part, out)])])

    now = written(parts, "summaries")
    top, dims = now.agg(F.max("part"), F.max(F.size("mean"))).first()
    fan = max(2, min(64, TASK_BYTES // (8 * (dims or 1) ** 2)))
    while top is not None:
        level = now.withColumn("part", F.floor(F.col("part") / fan)).groupBy("dims", "part").applyInArrow(fold, _PARTS)
        before, now = now, written(level, "summaries")
        forget(before)
        if not top // fan:
            break
        top //= fan
    return now


def components(parts: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """The model of each length: n, sums, mean, and its first components with sqrt(e) and e / trace(V)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _unpacked(row)
                dims = len(s.mean)
                full = np.vstack([s.root, np.zeros((max(0, min(count, dims) - len(s.root)), dims))])
                _, values, vt = np.linalg.svd(full, full_matrices=False)
                none = values <= values[0] * np.finfo(float).eps * max(len(full), dims)
                values = np.where(none, 0.0, values)
                trace = float((values**2).sum())
                axes = []
                for k in range(min(count, dims)):
                    axis = vt[k] * (1.0 if vt[k][np.argmax(np.abs(vt[k]))] > 0 else -1.0)
                    axes.append({"component": k + 1, "axis": axis.tolist(), "scale": float(values[k]) / s.n**0.5, "explained": float(values[k]) ** 2 / trace if trace else 0.0})
                sums = [v if -(1 << 63) <= v < 1 << 63 else None for v in s.sums]
                yield pa.RecordBatch.from_pylist([{"dims": row["dims"], "n": s.n, "sums": sums, "mean": s.mean.tolist(), "axes": axes}], schema=_model_type())

    return parts.mapInArrow(work, _MODEL)


def _model_type() -> pa.Schema:
    axis = pa.struct([("component", pa.int32()), ("axis", pa.list_(pa.float64())), ("scale", pa.float64()), ("explained", pa.float64())])
    return pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("axes", pa.list_(axis))])


# -- the model's use

#: The vector about the mean is made once, then projected on each component.
_PROJECTED = """transform(array(zip_with(x, mean, (a, m) -> a - m)), d -> transform(axes, c -> named_struct(
    'component', c.component, 'explained', c.explained,
    'whitened', if(c.scale > 0, aggregate(zip_with(d, c.axis, (y, v) -> y * v), 0D, (s, y) -> s + y) / c.scale, null))))[0]"""
_DEVIATION = """aggregate(zip_with(x, sums, (a, s) -> try_subtract(try_multiply(n, a), s)), 0L, (t, d) -> try_add(t, try_multiply(d, d)))"""


def fit(rows: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """The model for the rows of :func:`integer_vectors`, written: one row a length, with the measured identity_error."""
    distinct = written(rows.groupBy("dims", "x").agg(F.lit(1).alias("one")).select("dims", "x"), "vectors")
    parts = merged(summaries(distinct))
    model = written(components(parts, count), "model")
    forget(parts)
    sure = F.expr(f"transform(filter({_PROJECTED}, c -> c.whitened is not null), c -> c.whitened)")
    white = _with_model(distinct, model).select("dims", sure.alias("x")).where(F.size("x") > 0)
    left = merged(summaries(white))

    def error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = []
            for row in batch.to_pylist():
                s = _unpacked(row)
                off.append(float(np.abs(s.root.T @ s.root / s.n - np.eye(len(s.mean))).max()))
            yield pa.RecordBatch.from_arrays([batch.column("dims"), pa.array(off, pa.float64())], ["dims", "identity_error"])

    errors = left.mapInArrow(error, "dims int, identity_error double")
    out = written(model.join(errors, "dims", "left"), "model")
    for done in (distinct, model, left):
        forget(done)
    return out


def _with_model(rows: DataFrame, model: DataFrame) -> DataFrame:
    size = model.agg(F.sum(F.col("dims").cast("long") * 8 * (COMPONENTS + 3))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(model), "dims")
    rows = rows.withColumn("__tessella_by", F.monotonically_increasing_id())
    sizes = written(rows.groupBy("dims").count(), "lengths")
    return salted(rows, model.join(sizes, "dims"), "dims", "count", "__tessella_by", sizes).drop("__tessella_by")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per vector that stays: row, id, dims, n, deviation, identity_error, and ``components``, an array of
    struct<component, explained, whitened> (see the module's text)."""
    ready(vectors.sparkSession)
    rows = integer_vectors(vectors, id_col, vec_col)
    model = fit(rows, count)
    return _with_model(rows, model).select("row", "id", "dims", "n", F.expr(_DEVIATION).alias("deviation"), "identity_error", F.expr(_PROJECTED).alias("components"))

"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Words are runs of letters, digits and non-ASCII characters, or runs of other visible characters. Features are
hashes of single words (case kept), of pairs of neighbours, and of triples of word shapes (a word's kind and
letter case, and whether it repeats the word before), so that layout, shouting and stuttering are seen in
words never met before. A feature's value is its count divided by the number of features of its kind in the
text: long and short texts weigh alike. A text's score is one sparse dot product and a logistic function.

Training reads labelled rows that aren't held out, at most ``train_rows`` in expectation, chosen by a hash of
the id; their sparse features (not texts) meet in one task, whose size the parameter bounds. Updates run
in a fixed order, one example at a time, for ``epochs`` passes.

Defined results. Null texts count as empty; empty texts get the score of the bias alone. Labels other than 0
and 1 aren't learnt from. If several rows give an id different texts or
labels, each is an example; equal ones are one. If there is nothing to
learn from, every score is 0.5. Whole texts are read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import scan
from tessella.llm.shared import held_out, ready

BITS = 18
#: Labelled documents to learn from, in expectation.
TRAIN_ROWS = 6_000
EPOCHS = 3
#: FTRL-proximal: learning rate, its offset, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 lower letter or other, 2 upper letter, 3 digit, 4 mark
_KIND[33:128] = 4
_KIND[48:58] = 3
_KIND[65:91] = 2
_KIND[97:123] = 1
_KIND[128:] = 1


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, offsets, feature indices, values): sparse rows of one piece of the column after another."""
    mask = np.uint64((1 << bits) - 1)
    for at, to, data, offsets in scan.pieces(column):
        kind = _KIND[data]
        word = (kind > 0) & (kind < 4)
        a = scan.word_bounds(word, offsets)
        b = scan.word_bounds(kind == 4, offsets)
        starts, ends, row = (np.concatenate(x) for x in zip(a, b, strict=True))
        order = np.argsort(starts, kind="stable")
        starts, ends, row = starts[order], ends[order], row[order]
        mark = order >= len(a[0])
        hashes = scan.word_hashes(data, starts, ends)
        upper = np.concatenate([[0], np.cumsum(kind == 2)])
        digit = np.concatenate([[0], np.cumsum(kind == 3)])
        n_up = upper[ends] - upper[starts] if len(starts) else np.empty(0, np.int64)
        n_digit = digit[ends] - digit[starts] if len(starts) else np.empty(0, np.int64)
        first_up = kind[starts] == 2 if len(starts) else np.empty(0, bool)
        shape = np.where(mark, 1, np.where(n_digit > 0, 2, np.where((n_up > 1) & (2 * n_up >= ends - starts), 3, np.where(first_up, 4, 5)))).astype(np.uint64)
        last = np.zeros(len(row), bool)
        same_row = np.zeros(len(row), bool)
        same_row[1:] = row[1:] == row[:-1]
        last[1:] = same_row[1:] & (hashes[1:] == hashes[:-1])
        shape = np.where(last, np.uint64(6), shape)
        text = np.where(mark, scan.mixed(hashes ^ np.uint64(77)), hashes)
        pair = same_row.copy()
        triple = same_row.copy()
        triple[1:] &= same_row[:-1]
        p, t = np.flatnonzero(pair), np.flatnonzero(triple)
        groups = [
            (row, text),
            (row[p], scan.mixed(text[p - 1] * np.uint64(5) + text[p])),
            (row[t], scan.mixed((shape[t - 2] * np.uint64(64) + shape[t - 1] * np.uint64(8) + shape[t]) ^ np.uint64(0xABCD_0000))),
            (row, scan.mixed(shape ^ np.uint64(0x1234_0000))),
        ]
        n = to - at
        keys, values = [], []
        for own, h in groups:
            total = np.bincount(own, minlength=n)
            keys.append((own.astype(np.uint64) << np.uint64(bits)) | (h & mask))
            values.append(1.0 / total[own])
        keys, values = np.concatenate(keys), np.concatenate(values)
        keys, inverse = np.unique(keys, return_inverse=True)
        values = np.bincount(inverse, values, minlength=len(keys))
        own = (keys >> np.uint64(bits)).astype(np.int64)
        yield at, np.searchsorted(own, np.arange(n + 1)), (keys & mask).astype(np.int32), values.astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (the last one is the bias) after FTRL-proximal updates over the examples in order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(epochs):
        for index, value, label in examples:
            i = np.append(index, size - 1)
            x = np.append(value, 1.0).astype(np.float64)
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(size))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, out: Column | None = None, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray | None:
    """Weights learnt from labelled rows that aren't held out; None if there are none."""
    ready(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.where(~(held_out("id") if out is None else out))
    n = known.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), F.lit(1 << 30))
    known = known.where(place < int(min(1.0, train_rows / n) * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    rows = rows.dropDuplicates(["id", "text", "label"])  # an id that repeats is one example

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, cut, index, value in features(batch.column("text"), bits):
                k = len(cut) - 1
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, t))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, k).cast(pa.string()), batch.column("label").slice(at, k), lists(index, pa.int32()), lists(value, pa.float32())], ["id", "label", "index", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for name, label, index, value in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("index"), batch.column("value"), strict=True):
                index, value = index.values.to_numpy(), value.values.to_numpy()
                examples.append((scan.mixed(np.array([hash_of(name)], np.uint64))[0], index, value, label))
        if examples:
            examples.sort(key=lambda x: (x[0], len(x[1]), x[3]))
            w = train([x[1:] for x in examples], bits, epochs)
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()])], ["w"])

    sparse = rows.mapInArrow(extract, "id string, label int, index array<int>, value array<float>")
    got = sparse.repartition(1).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32) if got else None


def hash_of(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode())


def score(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: id, score (higher: label 1 is likelier)."""
    spark = docs.sparkSession
    ready(spark)
    kept = spark.sparkContext.broadcast(np.zeros((1 << bits) + 1, np.float32) if weights is None else weights)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = kept.value.astype(np.float64)
        for batch in batches:
            for at, cut, index, value in features(batch.column("text"), bits):
                sums = np.concatenate([[0.0], np.cumsum(w[index] * value)])
                x = sums[cut[1:]] - sums[cut[:-1]] + w[-1]
                s = 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(s)), pa.array(s)], ["id", "score"])

    return narrow.mapInArrow(work, f"id {dict(narrow.dtypes)['id']}, score double")

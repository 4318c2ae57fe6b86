"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ``width`` consecutive words of the benchmark items; an item of fewer words, but
not none, is one window. The search runs over the word sequence of each text. Its alphabet is words, so a
block is two neighbouring words (one, for windows of one word):

* a shift table over hashed blocks says how far a window's end may move without missing an occurrence;
* where the shift is 0, the hash of the window's last block selects a bucket of candidate windows;
* candidates are confirmed by comparing the words themselves, byte by byte.

Many positions are searched in step: a piece of text is cut into lanes, and numpy moves all lanes at once,
each by its own shift. Windows of different length have tables of their own.

The benchmark is the stated query set. Its windows are broadcast in blocks of at most ``block_bytes`` of
text; a larger benchmark takes more passes over the documents, whose hits are then united per document.

Defined results. Words are maximal runs of digits, letters and non-ASCII characters after A-Z are
lower-cased. Null texts have no words; null items have no windows; a null item id counts as an empty string.
Several items may share a window; each counts. Repeated rows are judged one by one. Other columns of either
table are ignored. An empty benchmark hits nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import scan
from tessella.llm.shared import keyed, ready, without, written

WIDTH = 13
#: Benchmark text that one broadcast may hold.
BLOCK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Words:
    """The words of a piece: hashes, rows, and their bytes with single spaces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        is_word = _WORD[low]
        starts, ends, self.row = scan.word_bounds(is_word, offsets)
        self.hash = scan.word_hashes(low, starts, ends)
        out, self.start, self.end = scan.joined(low, is_word, starts, ends)
        self.bytes = out.tobytes()


def _block(hashes: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each ``last``."""
    if size == 1:
        return hashes[last]
    return scan.mixed(hashes[last - 1] * np.uint64(3) + hashes[last])


class Tables:
    """Shift table and suffix buckets of all windows of one length."""

    BITS = 17
    LANE = 192

    def __init__(self, length: int, hashes: np.ndarray, texts: list[bytes]):
        self.length, self.size = length, min(2, length)
        self.reach = length - self.size + 1
        at = np.zeros(len(hashes), np.int64)
        self.shift = np.full(1 << self.BITS, self.reach, np.int64)
        flat = hashes.reshape(-1)
        base = np.arange(len(hashes)) * length
        for end in range(self.size - 1, length):
            code = _block(flat, base + end, self.size)
            np.minimum.at(self.shift, self._slot(code), length - 1 - end)
        suffix = _block(flat, base + length - 1, self.size)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.hashes, self.ids = suffix[order], hashes[order], at + order
        self.texts = texts

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, window) of every occurrence."""
        n, m = len(words.hash), self.length
        none = np.empty(0, np.int64)
        if n < m:
            return none, none
        pos = np.arange(m - 1, n, self.LANE)
        stop = np.minimum(pos + self.LANE, n)
        ends = []
        while len(pos):
            step = self.shift[self._slot(_block(words.hash, pos, self.size))]
            ends.append(pos[step == 0])
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        ends = np.concatenate(ends)
        first = ends - (m - 1)
        inside = words.row[first] == words.row[ends]
        first, ends = first[inside], ends[inside]
        code = _block(words.hash, ends, self.size) if len(ends) else np.empty(0, np.uint64)
        lo, hi = np.searchsorted(self.suffix, code, "left"), np.searchsorted(self.suffix, code, "right")
        count = hi - lo
        first = np.repeat(first, count)
        entry = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(first))
        for k in range(m):  # cheap words first: most false candidates end here
            same = words.hash[first + k] == self.hashes[entry, k]
            first, entry = first[same], entry[same]
        window = self.ids[entry]
        sure = [words.bytes[a:b] == self.texts[w] for a, b, w in zip(words.start[first].tolist(), words.end[first + m - 1].tolist(), window.tolist(), strict=True)]
        sure = np.array(sure, bool)
        return first[sure], window[sure]


def build(items: list[tuple[str, str]], width: int = WIDTH) -> tuple[list[Tables], list[list[int]], list[str]]:
    """Tables by window length, for each table's window the item numbers (one list after another), and the item ids."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = {}
    names: dict[str, int] = {}
    for item, text in items:
        for _, _, data, offsets in scan.pieces(pa.array([text])):
            words = Words(data, offsets)
            n = len(words.hash)
            m = min(width, n)
            for k in range(n - m + 1 if n else 0):
                key = words.bytes[words.start[k] : words.end[k + m - 1]]
                got = by_length.setdefault(m, {}).setdefault(key, (words.hash[k : k + m].copy(), set()))
                got[1].add(names.setdefault(item, len(names)))
    tables, owners = [], []
    for m, found in sorted(by_length.items()):
        tables.append(Tables(m, np.array([x[0] for x in found.values()]).reshape(-1, m), list(found)))
        owners.append([sorted(x[1]) for x in found.values()])
    return tables, owners, list(names)


def hits(words: Words, tables: list[Tables], owners: list[list[list[int]]], rows: int) -> tuple[np.ndarray, list[set[int]]]:
    """Which words are hit, and each row's items."""
    change = np.zeros(len(words.hash) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(rows)]
    for t, own in zip(tables, owners, strict=True):
        first, window = t.find(words)
        np.add.at(change, first, 1)
        np.add.at(change, first + t.length, -1)
        for r, w in set(zip(words.row[first].tolist(), window.tolist(), strict=True)):
            items[r].update(own[w])
    return np.cumsum(change)[:-1] > 0, items


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of bounded size, streamed partition by partition to the driver."""
    now, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        text = text or ""
        now.append((item, text))
        size += len(text.encode())
        if size >= block_bytes:
            yield now
            now, size = [], 0
    if now:
        yield now


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, n_words long, n_hit long, items array<string> (sorted), spans array<struct<first, last>>.

    A span is a maximal run of hit words, by word numbers from 0.
    """
    spark = docs.sparkSession
    ready(spark)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        model = spark.sparkContext.broadcast(pickle.dumps(build(first, width)))
        return narrow.mapInArrow(_searcher(model, False), _schema(narrow, False))
    # One block after the other is read, searched and let go; what is kept is each one's hits, and all rows of the first.
    narrow = written(narrow.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for part in chain([first, second], parts):
        model = spark.sparkContext.broadcast(pickle.dumps(build(part, width)))
        one = narrow.mapInArrow(_searcher(model, True), _schema(narrow, True))
        one = written(one if found is None else one.where("n_hit > 0"), "hits")
        model.destroy()
        found = one if found is None else found.unionByName(one)
    spans = F.flatten(F.collect_list("spans"))
    by = found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(spans).alias("s"))
    merged = F.expr(
        """aggregate(s, cast(array() as array<struct<first: bigint, last: bigint>>), (acc, x) ->
           if(size(acc) > 0 and x.first <= element_at(acc, -1).last + 1,
              concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last)))),
              concat(acc, array(x))))"""
    )
    by = by.withColumn("spans", merged)
    hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.last - x.first + 1)")
    return by.select("id", "n_words", hit.alias("n_hit"), "items", "spans")


def _schema(narrow: DataFrame, row: bool) -> str:
    kind = dict(narrow.dtypes)["id"]
    return f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<first: bigint, last: bigint>>" + ", row bigint" * row


def _searcher(model, row: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, owners, names = pickle.loads(model.value)
        for batch in batches:
            for at, to, data, offsets in scan.pieces(batch.column("text")):
                words = Words(data, offsets)
                hit, items = hits(words, tables, owners, to - at)
                count = lambda x: np.bincount(x, minlength=to - at)  # noqa: B023, E731
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                edge = edge.reshape(-1, 2)
                spans: list[list[dict]] = [[] for _ in range(to - at)]
                begin = np.searchsorted(words.row, np.arange(to - at))
                for a, b in edge.tolist():  # a run may cross from row to row
                    while a < b:
                        r = int(words.row[a])
                        c = min(b, int(begin[r + 1]) if r + 1 < to - at else len(hit))
                        spans[r].append({"first": a - int(begin[r]), "last": c - 1 - int(begin[r])})
                        a = c
                named = [sorted(names[i] for i in x) for x in items]
                cols = [batch.column("id").slice(at, to - at), pa.array(count(words.row), pa.int64()), pa.array(count(words.row[hit]), pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
                keys = ["id", "n_words", "n_hit", "items", "spans"]
                if row:
                    cols.append(batch.column("row").slice(at, to - at))
                    keys.append("row")
                yield pa.RecordBatch.from_arrays(cols, keys)

    return search


def contaminated() -> Column:
    """The rule: some word is hit, and one in twenty or more are."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    docs = keyed(docs, id_col, nulls_last=True)
    found = decontaminate(docs, benchmark, "__tessella_key", text_col, **options)
    return without(docs, written(found.where(contaminated()).select(F.col("id").alias("__tessella_key")), "contaminated"))

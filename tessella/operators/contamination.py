"""Overlap of training data with a benchmark: exact on query keys, near by cosine of character 4-gram counts.

The benchmark is the query set: it is broadcast in blocks of bounded size, and every training row is scored
against each block where it lies after the texts are dealt out evenly, so no grams of the training data are ever shuffled. Grams are hashed and
counted for many texts at once, and looked up in the block's inverted index. A task keeps its own best ``top_k``
rows for each benchmark case; a window over those gives the whole's. The scores they have reached say which grams still
lead to candidates, and which candidates can still be among the best, so that few pairs are scored and none that matters is
missed. Where a block's texts are few and long, one matrix product bounds all scores from above, and only pairs whose bound reaches the best
rows so far are scored. Else grams that many of a block's texts have are multiplied as matrices of counts, exactly, and only the others are looked up.
A worker holds the index, its best rows and a bounded number of pairs, but never a score for each row and case.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.batched import batched
from tessella.session import ready, written

#: Benchmark text that one broadcast may hold.
BLOCK_BYTES = 8 << 20


def exact_matches(train: DataFrame, bench: DataFrame, keys: list[str], train_id: str = "train_id", bench_id: str = "bench_id", most: int = 10) -> DataFrame:
    """bench id, n_hits, first_hits: the training rows that share all keys, the ``most`` smallest ids listed.

    Lists are cut after counting; both are over partial aggregates of (case, training row) pairs of equal keys.
    """
    hits = bench.select(bench_id, *keys).join(train.select(train_id, *keys), keys)
    rank = F.row_number().over(W.partitionBy(bench_id).orderBy(train_id))
    first = hits.withColumn("__r", rank).where(F.col("__r") <= most).groupBy(bench_id).agg(F.array_sort(F.collect_list(train_id)).alias("first_hits"))
    return hits.groupBy(bench_id).agg(F.count(F.lit(1)).alias("n_hits")).join(first, bench_id)


#: Multiplier of the polynomial gram hash, and the bits of it that are kept (the others hold a row's number in its piece).
_BASE, _BITS = np.uint64(0x9E3779B97F4A7C15), 52
#: Texts are counted in pieces of at most so many rows, and of about so many characters.
_ROWS, _CHARS = 1 << 12, 1 << 20
#: Stands after texts that are shorter than a gram; no text can hold it.
_PAD = "\ud800"
#: (gram, benchmark row) pairs that are added up at once, and (row, benchmark row) sums that are held at once.
_PAIRS, _TILE = 1 << 20, 1 << 21
#: Pairs for each posting from which skipping grams is tried, and the share of pairs that may be left for it to be worth it.
_TRAFFIC, _LEFT = 4, 0.5
#: A gram that one in so many texts of a block has is multiplied, not looked up; counts that such a matrix may hold.
_COMMON, _CELLS = 40, 1 << 24
#: Most and fewest columns of the matrices that bound scores: so many for grams of their own, and so many that all others share. With
#: blocks of so many texts that the cells above give fewer, scores aren't bounded: such texts are short and soon looked up.
_COLUMNS, _FEWEST = 1 << 11, 1 << 8
#: Sums of so many products of single precision, none negative, are off by less than this share.
_SLACK = 1e-3
#: Single precision adds whole numbers exactly below this.
_EXACT = 1 << 24


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, packed texts) of bounded size; a single longer text is a piece of its own."""
    first, size, now = 0, 0, []
    for k, text in enumerate(texts):
        if now and (len(now) == _ROWS or size + len(text or "") > _CHARS):
            yield first, now
            first, size, now = k, 0, []
        now.append("".join((text or "").split()).lower())
        size += len(text or "")
    if now:
        yield first, now


def gram_counts(packed: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of all different grams of some texts, and each text's norm. A gram is the hash of its characters."""
    packed = [t if not t or len(t) >= n else t + _PAD * (n - len(t)) for t in packed]
    row = np.repeat(np.arange(len(packed), dtype=np.uint64), [len(t) for t in packed])
    codes = np.frombuffer("".join(packed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, np.zeros(len(packed))
    last = len(codes) - n + 1
    gram = np.zeros(last, np.uint64)
    for k in range(n):
        gram = gram * _BASE + codes[k : last + k]
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0x81DADEF4BC2DD44D)
    key = np.sort((row[:last] << np.uint64(_BITS) | gram >> np.uint64(64 - _BITS))[row[:last] == row[n - 1 :]])
    edge = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    count = np.diff(edge, append=len(key))
    row, gram = (key[edge] >> np.uint64(_BITS)).astype(np.int64), key[edge] & np.uint64((1 << _BITS) - 1)
    return row, gram, count, np.sqrt(np.bincount(row, count.astype(float) ** 2, len(packed)))


@batched("struct<n_grams: bigint, n_distinct: bigint>")
def char_gram_counts(text: pd.Series) -> pd.DataFrame:
    """How many 4-grams the packed text has, and how many different ones; null and empty texts have none. Many texts are counted at once."""
    out = np.zeros((len(text), 2), np.int64)
    for at, packed in _pieces(text.tolist()):
        row, _, count, _ = gram_counts(packed, 4)
        out[at : at + len(packed), 0] = np.bincount(row, count, len(packed))
        out[at : at + len(packed), 1] = np.bincount(row, minlength=len(packed))
    return pd.DataFrame(out, columns=["n_grams", "n_distinct"])


class Index:
    """The gram counts of a block of benchmark texts, by text and by gram.

    A text's grams are in order of their rarity in the block, the common ones last. ``bound`` is the length of the text's
    unit vector over a gram and all that come after it. Rows whose own length over the same grams is known share at most the
    product with it, so once a text's best rows have reached some score, its common grams no longer lead to candidates.
    """

    def __init__(self, rows: list[tuple], n: int):
        self.n, self.ids = n, [r[0] for r in rows]
        parts = [(at + row, gram, count, norms) for at, texts in _pieces([r[1] for r in rows]) for row, gram, count, norms in [gram_counts(texts, n)]]
        item, gram, count, self.norms = (np.concatenate(x) if x else np.empty(0) for x in (zip(*parts, strict=True) if parts else ((),) * 4))
        self.grams, place = np.unique(gram, return_inverse=True)
        self.rank = np.empty(len(self.grams), np.int64)  # by rarity
        self.rank[np.argsort(np.bincount(place, minlength=len(self.grams)), kind="stable")] = np.arange(len(self.grams))
        order = np.lexsort((self.rank[place], item))
        self.item, self.place, self.count = item[order].astype(np.int32), place[order].astype(np.int32), count[order].astype(np.int32)
        self.first = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        left = np.cumsum(np.square(self.count, dtype=np.int64)[::-1])[::-1]  # of this text and all later ones, exactly
        after = np.append(left, 0)[self.first[1:]][self.item] if len(order) else left
        self.bound = np.sqrt((left - after) / np.square(self.norms[self.item]) + 1e-9).astype(np.float32) if len(order) else np.empty(0, np.float32)
        self.postings = np.argsort(self.place, kind="stable").astype(np.int32)
        self.begin = np.searchsorted(self.place[self.postings], np.arange(len(self.grams) + 1))


class Best:
    """The ``top_k`` best rows of each text of a block among the rows that a task has seen, of those that score ``floor`` or more."""

    def __init__(self, index: Index, top_k: int, floor: float = 0.0):
        self.index, self.top_k, self.floor = index, top_k, floor
        m = len(index.ids)
        self.least = np.full(m, floor)  # a row below can't be among a text's best
        # The grams that most texts of the block have, by column of a matrix; the postings are those of all others.
        found = np.diff(index.begin)
        common = np.argsort(-found, kind="stable")[: _CELLS // max(1, m)]
        common = common[found[common] * _COMMON >= m]
        self.column = np.full(len(index.grams), -1)
        self.column[common] = np.arange(len(common))
        entry = self.column[index.place] if len(index.place) else np.empty(0, np.int64)
        self.dense = np.zeros((m, len(common)), np.float32 if index.norms.max(initial=0) < _EXACT else np.float64)
        self.dense[index.item[entry >= 0], entry[entry >= 0]] = index.count[entry >= 0]
        self.common = entry >= 0
        self.postings = index.postings[~self.common[index.postings]]
        self.begin = np.searchsorted(index.place[self.postings], np.arange(len(index.grams) + 1))
        self.score = np.zeros((m, top_k))  # falling; 0: no row yet
        self.id = np.empty((m, top_k), object)
        # A gram's column in the matrix of bounds. By Cauchy and Schwarz, column by column, no score is above the product of two texts'
        # lengths over the columns, and as most texts have few of the grams that share one, it is close to it.
        rank = np.empty(len(found), np.int64)
        rank[np.argsort(-found, kind="stable")] = np.arange(len(found))
        columns = max(1, min(_COLUMNS, _CELLS // (2 * max(1, m))))
        self.share = np.where(rank < columns, rank, columns + rank % columns)
        self.width = int(self.share.max(initial=-1)) + 1
        self.bounds = None
        if m and self.width and columns >= _FEWEST:
            step = max(1, _TILE // self.width)
            self.bounds = np.concatenate([self._lengths(*self._part(k, min(m, k + step))) for k in range(0, m, step)])
            self.dense, self.postings = self.dense[:, :0], self.postings[:0]
            self.places, self.counts, self.row = index.place.astype(np.intp), index.count.astype(float), np.zeros(len(index.grams))

    def _part(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Some of the block's own texts as rows."""
        i = self.index
        own = slice(i.first[begin], i.first[end])
        return i.item[own].astype(np.int64) - begin, i.place[own], i.count[own], i.norms[begin:end]

    def _lengths(self, row: np.ndarray, place: np.ndarray, count: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The length of each row's unit vector over the grams of each column."""
        square = np.bincount(row * self.width + self.share[place], np.square(count / norms[row]), len(norms) * self.width)
        return np.sqrt(square).astype(np.float32).reshape(len(norms), self.width)

    def _likely(self, row: np.ndarray, place: np.ndarray, count: np.ndarray, norms: np.ndarray, names: list, at: int) -> None:
        """Bounds of the scores of a few rows and all the block's texts, the exact scores of pairs that may be among the best, and who is then."""
        worth = self.bounds @ self._lengths(row, place, count, norms).T
        begin = np.searchsorted(row, np.arange(len(norms) + 1))

        def enough() -> np.ndarray:
            return (worth > 0) & (worth >= (self.least * (1 - _SLACK)).astype(np.float32)[:, None])

        def score(pairs: np.ndarray) -> None:
            b, r = pairs // len(norms), pairs % len(norms)
            order = np.argsort(r, kind="stable")
            b, r = b[order], r[order]
            value = self._dots(begin, place, count, r, b) / (norms[r] * self.index.norms[b])
            good = (value > 0) & (value >= self.least[b])
            if good.any():
                self._keep(r[good], b[good], value[good], names, at)

        likely, k = enough(), self.top_k
        if k < len(norms) and np.count_nonzero(likely) > k * len(worth):
            # Many: each text's likeliest rows come first, and say who of the others still matters.
            first = np.zeros_like(likely)
            np.put_along_axis(first, np.argpartition(-worth, k, axis=1)[:, :k], True, axis=1)
            score(np.flatnonzero(first & likely))
            likely = enough() & ~first
        pairs = np.flatnonzero(likely)
        if len(pairs):
            score(pairs)

    def _dots(self, begin: np.ndarray, place: np.ndarray, count: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Dot products of pairs in order of their rows, over all grams, exactly: each text's grams are taken from the row's counts by gram."""
        i, out, now = self.index, np.empty(len(r)), -1
        own, places, first, counts = slice(0, 0), self.places, i.first.tolist(), self.counts
        for k, (x, y) in enumerate(zip(r.tolist(), b.tolist(), strict=True)):
            if x != now:
                self.row[place[own]] = 0
                now, own = x, slice(begin[x], begin[x + 1])
                self.row[place[own]] = count[own]
            text = slice(first[y], first[y + 1])
            out[k] = self.row.take(places[text]) @ counts[text]
        self.row[place[own]] = 0
        return out

    def _leads(self, row: np.ndarray, place: np.ndarray, count: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings that lead from these rows to candidates, where each gram's begin, and what each text's others are worth at most."""
        i = self.index
        none = np.zeros(len(i.ids))
        if (self.begin[place + 1] - self.begin[place]).sum() < _TRAFFIC * len(i.postings) or not self.least.any():
            return self.postings, self.begin, none
        order = np.lexsort((-i.rank[place], row))
        mass = np.cumsum(np.square(count[order], dtype=np.int64))
        head = np.searchsorted(row[order], row[order])
        mass = (mass - np.append(0, mass)[head]) / np.square(norms[row[order]])  # each row's over a gram and all more common ones
        most = np.zeros(len(i.grams))
        np.maximum.at(most, i.rank[place[order]], mass)
        most = np.sqrt(np.maximum.accumulate(most[::-1])[::-1])
        worth = i.bound * most[i.rank[i.place]]
        leads = self.common | (worth >= self.least[i.item] * (1 - 1e-6))
        postings = self.postings[leads[self.postings]]
        begin = np.searchsorted(i.place[postings], np.arange(len(i.grams) + 1))
        if (begin[place + 1] - begin[place]).sum() > _LEFT * (self.begin[place + 1] - self.begin[place]).sum():
            return self.postings, self.begin, none  # too few go to be worth an exact look at what is left
        some = np.flatnonzero(np.diff(i.first))
        none[some] = np.maximum.reduceat(np.where(leads, 0.0, worth), i.first[some])
        return postings, begin, none

    def _products(self, row: np.ndarray, place: np.ndarray, count: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What rows and all texts have in common by the grams of the matrix. All sums are whole numbers and exact: a sum
        is no more than the product of the norms, and where that is too large for single precision the row is multiplied in double."""
        column = self.column[place]
        row, column, count = row[column >= 0], column[column >= 0], count[column >= 0]
        large = norms * self.index.norms.max(initial=0) >= _EXACT
        out = np.zeros((len(norms), len(self.dense)))
        for kind, some in ((np.float32, np.flatnonzero(~large)), (np.float64, np.flatnonzero(large))):
            if not len(some) or not len(column):
                continue
            at = np.full(len(norms), -1)
            at[some] = np.arange(len(some))
            own = at[row] >= 0
            rows = np.zeros((len(some), self.dense.shape[1]), kind)
            rows[at[row[own]], column[own]] = count[own]
            for k in range(0, len(self.dense), 256):
                out[some, k : k + 256] = rows @ self.dense[k : k + 256].T.astype(kind, copy=False)
        return out.ravel()

    def take(self, texts: list[str | None], names: list) -> None:
        i, wide = self.index, self.dense.shape[1] if self.bounds is None else self.width
        step = max(1, min(_TILE // max(1, len(i.ids)), 2 * _TILE // max(1, wide)))
        some = self._some if self.bounds is None else self._likely
        for at, packed in _pieces(texts):
            row, gram, count, norms = gram_counts(packed, i.n)
            place = np.searchsorted(i.grams, gram)
            place[place == len(i.grams)] = 0
            hit = i.grams[place] == gram if len(i.grams) else np.zeros(len(gram), bool)
            row, place, count = row[hit], place[hit], count[hit]
            for first in range(0, len(packed), step):
                own = slice(*np.searchsorted(row, [first, first + step]))
                if own.stop > own.start:
                    some(row[own] - first, place[own], count[own], norms[first : first + step], names, at + first)

    def _some(self, row: np.ndarray, place: np.ndarray, count: np.ndarray, norms: np.ndarray, names: list, at: int) -> None:
        """Candidates among a few rows and all the block's texts, their exact scores, and who is among the best then."""
        i, m = self.index, len(self.index.ids)
        postings, starts, rest = self._leads(row, place, count, norms)
        dots = self._products(row, place, count, norms)
        size = starts[place + 1] - starts[place]
        total, begin = np.cumsum(size), 0
        while begin < len(row):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _PAIRS, "right")))
            own = size[begin:end]
            which = np.repeat(np.arange(begin, end), own)
            post = postings[np.arange(len(which)) + np.repeat(starts[place[begin:end]] - np.cumsum(own) + own, own)]
            dots += np.bincount(row[which] * m + i.item[post], count[which] * i.count[post].astype(float), len(dots))
            begin = end
        pair = np.flatnonzero(dots)
        r, b, dot = pair // m, pair % m, dots[pair]
        del dots
        scale = norms[r] * i.norms[b]
        likely = dot / scale + rest[b] >= self.least[b] * (1 - 1e-6)
        r, b, dot, scale = r[likely], b[likely], dot[likely], scale[likely]
        short = np.flatnonzero(rest[b] > 0)
        if len(short):
            dot[short] = self._exact(row, place, count, r[short], b[short])
        score = dot / scale
        good = score >= self.least[b]
        if good.any():
            self._keep(r[good], b[good], score[good], names, at)

    def _exact(self, row: np.ndarray, place: np.ndarray, count: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Dot products of pairs over all grams: each text's grams are looked up in the row's."""
        i = self.index
        order = np.argsort(row * len(i.grams) + place, kind="stable")
        keys, values = (row * len(i.grams) + place)[order], count[order]
        size = i.first[b + 1] - i.first[b]
        out, total, begin = np.zeros(len(b)), np.cumsum(size), 0
        while begin < len(b):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + _PAIRS, "right")))
            own = size[begin:end]
            which = np.repeat(np.arange(begin, end), own)
            entry = np.arange(len(which)) + np.repeat(i.first[b[begin:end]] - np.cumsum(own) + own, own)
            want = r[which] * len(i.grams) + i.place[entry]
            got = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            out[begin:end] = np.bincount(which - begin, np.where(keys[got] == want, values[got] * i.count[entry].astype(float), 0.0), end - begin)
            begin = end
        return out

    def _keep(self, r: np.ndarray, b: np.ndarray, score: np.ndarray, names: list, at: int) -> None:
        """Merge new rows with those that the same texts have; of equal scores the smaller id is better."""
        k = self.top_k
        order = np.lexsort((-score, b))
        r, b, score = r[order], b[order], score[order]
        lead = np.searchsorted(b, b)  # where the text's own rows begin
        kth = np.minimum(lead + k, np.searchsorted(b, b, "right")) - 1
        some = score >= score[kth]
        r, b, score = r[some], b[some], score[some]
        texts = np.unique(b)
        had = np.argwhere(self.score[texts] > 0)
        item = np.concatenate([texts[had[:, 0]], b])
        value = np.concatenate([self.score[texts][had[:, 0], had[:, 1]], score])
        ids = np.empty(len(item), object)
        ids[: len(had)] = self.id[texts][had[:, 0], had[:, 1]]
        ids[len(had) :] = [names[at + x] for x in r.tolist()]
        key = pd.Series(ids, dtype=object)
        rows = pd.DataFrame({"item": item, "score": value, "id": key if key.isna().any() else key.infer_objects()})
        order = rows.sort_values(["item", "score", "id"], ascending=[True, False, True], kind="stable").index.to_numpy()
        item, value, ids = item[order], value[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        best = place < k
        self.score[item[best], place[best]] = value[best]
        self.id[item[best], place[best]] = ids[best]
        self.least[texts] = np.maximum(self.score[texts, k - 1], self.floor)

    def rows(self) -> tuple[list, list, np.ndarray]:
        """The block's ids, the rows' ids and the scores of all that was found."""
        b, k = np.nonzero(self.score > 0)
        return [self.index.ids[x] for x in b.tolist()], self.id[b, k].tolist(), self.score[b, k]


def top_matches(train: DataFrame, bench: DataFrame, train_id: str = "train_id", bench_id: str = "bench_id", train_text: str = "train_text", bench_text: str = "bench_text", n: int = 4, top_k: int = 5, block_bytes: int = BLOCK_BYTES, floor: float = 0.0) -> DataFrame:
    """bench id, rank from 0, train id, similarity (unrounded). Equal scores are ordered by training id. Of the ``top_k`` only
    those that score ``floor`` or more are given: for readers that take no others, who then needn't wait for them.

    Defined results: null and empty texts match nothing; a text of ``n`` characters or fewer is one gram; null ids come last among
    equal scores. Blocks are scanned one after the other; each one's matches are kept and its broadcast let go.
    """
    spark = train.sparkSession
    ready(spark)
    kinds = dict(train.dtypes)[train_id], dict(bench.dtypes)[bench_id]
    arrow = to_arrow_type(train.schema[train_id].dataType), to_arrow_type(bench.schema[bench_id].dataType)
    narrow = train.select(F.col(train_id).alias("t"), F.col(train_text).alias("x"))
    # A file may be cut into fewer pieces than there are cores; comparing costs far more than moving the texts once.
    narrow = narrow.repartition(max(narrow.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))

    def scorer(kept):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(kept.value, top_k, floor)
            for batch in batches:
                best.take(batch.column("x").to_pylist(), batch.column("t").to_pylist())
            b, t, score = best.rows()
            if b:
                yield pa.RecordBatch.from_arrays([pa.array(b, arrow[1]), pa.array(t, arrow[0]), pa.array(score, pa.float64())], ["b", "t", "similarity"])

        return work

    def blocks() -> Iterator[list[tuple]]:
        block, size = [], 0
        for row in bench.select(bench_id, bench_text).toLocalIterator():
            block.append(tuple(row))
            size += len((row[1] or "").encode())
            if size >= block_bytes:
                yield block
                block, size = [], 0
        if block:
            yield block

    def scan(block: list[tuple]):
        kept = spark.sparkContext.broadcast(Index(block, n))
        return kept, narrow.mapInArrow(scorer(kept), f"b {kinds[1]}, t {kinds[0]}, similarity double")

    found, parts = None, blocks()
    block, after = next(parts, []), next(parts, None)
    if after is None:
        _, found = scan(block)
    for block in [] if after is None else chain([block, after], parts):
        kept, one = scan(block)
        one = written(one, "matches")
        kept.destroy()
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(W.partitionBy("b").orderBy(F.desc("similarity"), F.asc_nulls_last("t"))) - 1
    return found.withColumn("rank", rank).where(F.col("rank") < top_k).select(F.col("b").alias(bench_id), "rank", F.col("t").alias(train_id), "similarity")


def summary(top: DataFrame, threshold: float = 0.8, bench_id: str = "bench_id") -> DataFrame:
    """One row: cases whose best score reaches the threshold, and pairs within the top that do."""
    hit = F.col("similarity") >= threshold
    return top.agg(F.count_if(hit & (F.col("rank") == 0)).alias("n_near_cases"), F.count_if(hit).alias("n_near_pairs"), F.count_distinct(bench_id).alias("n_matched_cases"))


def near_by_category(top: DataFrame, bench: DataFrame, threshold: float = 0.8, bench_id: str = "bench_id") -> DataFrame:
    """category, n_pairs: the pairs within the top that reach the threshold, by the benchmark row's category, in its order."""
    return top.where(F.col("similarity") >= threshold).join(bench.select(bench_id, "category"), bench_id).groupBy("category").agg(F.count(F.lit(1)).alias("n_pairs")).orderBy("category")


def report(bench: DataFrame, exact: DataFrame, exact_tools: DataFrame, top: DataFrame, threshold: float = 0.8, bench_id: str = "bench_id") -> DataFrame:
    """One row: benchmark cases, those with exact overlap (by query, and by query and tools), near cases and pairs, and the gate's status."""
    near = top.where(F.col("similarity") >= threshold)
    parts = {
        "n_cases": bench.agg(F.count(F.lit(1)).alias("n")),
        "n_exact_cases": exact.agg(F.count_distinct(bench_id).alias("n")),
        "n_exact_tools_cases": exact_tools.agg(F.count_distinct(bench_id).alias("n")),
        "n_near_cases": near.where("rank = 0").agg(F.count(F.lit(1)).alias("n")),
        "n_near_pairs": near.agg(F.count(F.lit(1)).alias("n")),
    }
    counts = None
    for name, part in parts.items():
        part = part.withColumn("name", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    one = counts.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts))
    return one.withColumn("status", F.when(F.col("n_exact_cases") > 0, 2).when(F.col("n_near_cases") > 0, 1).otherwise(0))


def listing(top: DataFrame, texts: DataFrame, train_id: str = "train_id", bench_id: str = "bench_id", least: float = 0.0, bench_chars: int = 300, train_chars: int = 500) -> DataFrame:
    """The pairs of a report from a score on, with their texts cut for reading; texts are joined for these few pairs only."""
    out = top.where(F.col("similarity") >= least).join(texts, train_id)
    return out.select(bench_id, "rank", train_id, F.round("similarity", 4).alias("similarity"), F.substring("bench_text", 1, bench_chars).alias("bench_text"), F.substring("train_text", 1, train_chars).alias("train_text"))


def gate(n_exact: int, n_near: int) -> int:
    """Exit status of a check: 2 exact overlap, 1 near overlap, 0 clean."""
    return 2 if n_exact else 1 if n_near else 0

"""SimHash near-dedup: fingerprints, a binary trie self-join, and components.

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of four words with repeats, each
hashed with XXH64 (seed 42); a bit is set if it is set in over half of the hashes.

Join: fingerprints at ``bits`` or fewer differing bits are linked. Distinct fingerprints are cut into blocks.
Two within the budget agree on some choice of blocks, so the join is split by the values of every choice; a
split is the subtree of a binary trie that fixes those bits. In a subtree pairs of trie nodes descend
together; differing bits add up, and a pair of nodes goes as soon as the sum exceeds the budget. A node is a
range of the sorted fingerprints. Node pairs that are small are compared directly, and pairs of nodes that
are wholly in one component already are skipped. Each subtree hands out a spanning forest of its links, not
all pairs of a group of copies. A subtree of more than ``hot`` fingerprints is dealt to salted pairs of parts.

Components: contracted over the forests' links (see ``components``), on fingerprints; copies of a text share
their fingerprint, so groups of copies of any size are one node. Rows get their component by a join on the fingerprint,
in which fingerprints of very many rows are dealt out.

Defined results. Null and empty texts, and texts of white space, have fingerprint 0, linked like any other.
Fewer than four words are one shingle. A component's id is the smallest id in it, null ids left aside; it is
null only if all of them are. Repeated rows appear each. Other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scan
from tessella.llm.components import components
from tessella.llm.shared import keyed, ready, salted, without, written

SHINGLE, SEED, BITS = 4, 42, 4
#: Fingerprints that one subtree may hold before it is dealt out in parts.
HOT = 200_000
#: Fingerprints in a subtree, on average, above which more bits are fixed.
DENSE = 4_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 per text."""
    out = np.zeros(len(column), np.uint64)
    xxh = xxhash.xxh64_intdigest
    for at, to, data, offsets in scan.pieces(column):
        low = _LOWER[data]
        is_word = _WORD[low]
        starts, ends, row = scan.word_bounds(is_word, offsets)
        if not len(starts):
            continue
        words, start, end = scan.joined(low, is_word, starts, ends)
        del low, is_word, starts, ends
        first = np.flatnonzero(np.diff(row, prepend=-1))  # each text's first word
        count = np.diff(np.append(first, len(row)))
        last = np.minimum(np.arange(len(row)) + shingle - 1, np.repeat(first + count - 1, count))
        keep = (np.arange(len(row)) == np.repeat(first, count)) | (np.arange(len(row)) + shingle - 1 <= np.repeat(first + count - 1, count))
        words = words.tobytes()
        a, b = start[keep].tolist(), end[last[keep]].tolist()
        hashes = np.fromiter((xxh(words[x:y], seed) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
        shingles = np.maximum(count - shingle + 1, 1)
        begin = np.cumsum(shingles) - shingles
        totals = np.zeros((len(shingles), 64), np.int64)
        step = 1 << 16
        owner = np.repeat(np.arange(len(shingles)), shingles)
        for k in range(0, len(hashes), step):
            bits = np.unpackbits(hashes[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[k : k + step]
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            totals[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        del begin
        over = (2 * totals > shingles[:, None]).astype(np.uint8)
        out[at + row[first]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, fp long (the fingerprint's 64 bits)."""
    ready(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fp = fingerprints_of(part.column("text"), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], ["id", "fp"])

    return narrow.mapInArrow(work, f"id {dict(narrow.dtypes)['id']}, fp bigint")


# -- the trie self-join of one or more subtrees


class Forest:
    """Union-find over positions, with labels that can be compared by the array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def trie_join(fps: np.ndarray, bounds: np.ndarray, bits: int = BITS, small: int = 1024, slice_: int = 1 << 20) -> np.ndarray:
    """Labels: the smallest position linked to each one, directly or not, inside its subtree.

    fps: uint64, sorted inside each subtree; bounds: where the subtrees begin, and the end.
    """
    n = len(fps)
    forest = Forest(n)
    if n < 2:
        return forest.label
    near = np.flatnonzero(np.bitwise_count(fps[1:] ^ fps[:-1]) <= bits)
    near = near[~np.isin(near + 1, bounds)]
    forest.union(near, near + 1)
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    some = hi - lo > 1
    # Rows: first node's range, second node's range, differing bits so far.
    ones_of: dict[int, np.ndarray] = {}  # of each bit that was looked at, how many fingerprints before a place have it
    todo = [(np.stack([lo[some], hi[some], lo[some], hi[some], np.zeros(some.sum(), np.int64)], 1), 63)]
    while todo:
        nodes, bit = todo.pop()
        if len(nodes) > slice_ // 8:  # bounded memory: the rest later
            todo.append((nodes[slice_ // 8 :], bit))
            nodes = nodes[: slice_ // 8]
        run = np.cumsum(np.diff(forest.label, prepend=-1) != 0)
        one = (run[nodes[:, 0]] == run[nodes[:, 1] - 1]) & (run[nodes[:, 2]] == run[nodes[:, 3] - 1]) & (forest.label[nodes[:, 0]] == forest.label[nodes[:, 2]])
        nodes = nodes[~one]
        work = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        leaf = (work <= small) | (bit < 0)
        _compare(fps, forest, nodes[leaf], work[leaf], bits, slice_)
        nodes = nodes[~leaf]
        if not len(nodes):
            continue
        ones = ones_of.get(bit)
        if ones is None:
            ones = ones_of[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)])
        a, b, c, d, used = nodes.T
        p, q = b - (ones[b] - ones[a]).astype(np.int64), d - (ones[d] - ones[c]).astype(np.int64)
        same = (a == c) & (b == d)
        pairs = [(a, p, c, q, used), (p, b, q, d, used), (a, p, q, d, used + 1), (p[~same], b[~same], c[~same], q[~same], used[~same] + 1)]
        below = np.concatenate([np.stack(x, 1) for x in pairs])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= bits)]
        if len(below):
            todo.append((below, bit - 1))
    return forest.label


def _compare(fps: np.ndarray, forest: Forest, nodes: np.ndarray, work: np.ndarray, bits: int, slice_: int) -> None:
    """Compare the fingerprints of small node pairs directly, so many at a time."""
    at = 0
    total = np.cumsum(work)
    while at < len(nodes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + slice_)))
        part, w = nodes[at:to], work[at:to]
        k = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        wide = np.repeat(part[:, 3] - part[:, 2], w)
        x, y = np.repeat(part[:, 0], w) + k // wide, np.repeat(part[:, 2], w) + k % wide
        close = np.bitwise_count(fps[x] ^ fps[y]) <= bits
        forest.union(x[close], y[close])
        at = to


def _choices(bits: int, fixed: int) -> list[int]:
    """Masks of which two fingerprints within the budget agree on at least one."""
    blocks = bits + fixed
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in itertools.combinations(masks, fixed)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, bits: int = BITS, hot: int = HOT, dense: int = DENSE) -> DataFrame:
    """distinct (fp long, no repeats) -> a, b: links whose components are those of all pairs within ``bits``."""
    spark = distinct.sparkSession
    ready(spark)
    n = distinct.count()
    fixed = next((f for f in range(1, 5) if n <= dense << (64 * f // (bits + f))), 5)
    masks = [_signed(m) for m in _choices(bits, fixed)]
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("choice", "value"))
    big = keyed.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    # At most rows / hot subtrees are big: a bounded table.
    parts = written(big.select("choice", "value", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "hot")
    if parts.limit(1).count():
        keyed = keyed.join(F.broadcast(parts), ["choice", "value"], "left")
        mine = F.expr("cast(pmod(xxhash64(fp), parts) as int)")
        pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(mine, j) * F.col("parts") + F.greatest(mine, j)))
        keyed = keyed.select("fp", "choice", "value", F.explode(pairs).alias("pair"))
    else:
        keyed = keyed.withColumn("pair", F.lit(0))
    return keyed.repartition("choice", "value", "pair").sortWithinPartitions("choice", "value", "pair", "fp").mapInArrow(_subtrees(bits), "a bigint, b bigint")


def _subtrees(bits: int, rows: int = 1 << 17):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(fps: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((fps, group))
            fps, group = fps[order], group[order]
            bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(fps))
            label = trie_join(fps, bounds, bits)
            child = np.flatnonzero(label != np.arange(len(fps)))
            signed = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[label[child]])], ["a", "b"])

        def joined(whole: bool) -> tuple[np.ndarray, np.ndarray, list]:
            """The fingerprints held and their groups' numbers; the last group waits unless it is whole."""
            key = [np.concatenate([x[k] for x in held]) for k in range(4)]
            new = np.ones(len(key[0]), bool)
            new[1:] = (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1]) | (key[3][1:] != key[3][:-1])
            cut = len(new) if whole else int(np.flatnonzero(new)[-1])
            rest = [[x[cut:] for x in key]] if cut < len(new) else []
            return key[0][:cut].view(np.uint64), np.cumsum(new)[:cut], rest

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in ("fp", "choice", "value", "pair")])
            size += batch.num_rows
            if size >= rows:
                fps, group, held = joined(False)
                size = sum(len(x[0]) for x in held)
                if len(fps):
                    yield out(fps, group)
        if held:
            fps, group, held = joined(True)
            yield out(fps, group)

    return work


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, hot: int = HOT, dense: int = DENSE) -> DataFrame:
    """One row per document: id, fp long, component_id, n_links (distinct fingerprints linked in its component, less one)."""
    marks = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), bits, hot, dense))
    linked = written(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    named = written(linked.join(whole, "root").select("fp", "n", "component_id", "n_links"), "named")
    return salted(marks, named, "fp", "n", "id").select("id", "fp", "component_id", "n_links")


def hex_of(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row (the smallest id) of each component."""
    docs = keyed(docs, id_col, nulls_last=True)
    found = near_dedup(docs, "__tessella_key", text_col, **options)
    return without(docs, written(found.where("id <> component_id").select(F.col("id").alias("__tessella_key")), "near"))

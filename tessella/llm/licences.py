"""Licence scans: matching statistics over a generalised suffix automaton of licence texts, chained into spans.

The templates' words and those of the phrases go into one suffix automaton. A text streams through it word by word; the
state and the length reached at a word are its matching statistic, the longest run of words that ends there and stands in some
template. From these statistics come

* phrases: a phrase ends wherever the state's run has it as its last words, that is, the phrase's own state lies on the
  state's path of suffix links. All places count, overlapping ones too;
* matches: runs of ``least`` words or more that can't go on to the right, with each place in each template. In each template
  those that follow each other in the text and in the template, at most ``gap`` words apart, are chained
  for the most covered template words. A chain that covers ``share`` of its template's words is a span. Where
  chains of several templates take the same words, the one that covers the most has them (of equals that of the larger share).

Only stretches in which each pair of neighbouring words stands in some template go through the automaton: elsewhere no
run is longer than one word, so no phrase or match can lie there. Pairs are found for all texts of a batch at once.

The automaton is broadcast. Templates are a stated set; more than ``TEMPLATE_WORDS`` words of them are an error (scan with a
part of them at a time). Texts aren't shuffled; a text's matches are its own task's memory.

Defined results. Words are maximal runs of digits, letters and non-ASCII characters after A-Z are lower-cased. Null and
empty texts have no words, no places and score 0. The score is 1 where a phrase stands, else the largest share of a span, else
0. Of equal chains the one whose template is named first has the words. Repeated rows are scanned one by one; the other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scan
from tessella.llm.decontaminate import Words
from tessella.llm.licence_texts import PHRASES, TEMPLATES
from tessella.llm.shared import ready

#: Words of a match that may be part of a chain, words between two of them, and a template's share that makes a span.
LEAST, GAP, SHARE = 4, 40, 0.6
#: Words of all templates together; the automaton has at most twice as many states of some hundred bytes.
TEMPLATE_WORDS = 200_000


class Automaton:
    """The generalised suffix automaton of several sequences of words."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Places (text, index of the last word) of which a state is the whole prefix.
        self.own: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extended(last, w)
                self.own[last].append((t, i))
        self.children: list[list[int]] = [[] for _ in self.link]
        for v, up in enumerate(self.link):
            if up >= 0:
                self.children[up].append(v)
        self._places: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int, link: int, follow: dict[bytes, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.own.append([])
        return len(self.link) - 1

    def _split(self, v: int, w: bytes) -> int:
        """The state of v's longest run followed by w, made out of the state that v has for w if that one is longer."""
        to = self.next[v][w]
        if self.length[to] == self.length[v] + 1:
            return to
        twin = self._state(self.length[v] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = twin
        while v >= 0 and self.next[v].get(w) == to:
            self.next[v][w] = twin
            v = self.link[v]
        return twin

    def _extended(self, last: int, w: bytes) -> int:
        if w in self.next[last]:  # another text has been here
            return self._split(last, w)
        new = self._state(self.length[last] + 1, 0, {})
        v = last
        while v >= 0 and w not in self.next[v]:
            self.next[v][w] = new
            v = self.link[v]
        if v >= 0:
            self.link[new] = self._split(v, w)
        return new

    def find(self, words: list[bytes]) -> int | None:
        """The state of a sequence of words."""
        v = 0
        for w in words:
            v = self.next[v].get(w)
            if v is None:
                return None
        return v

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """The matching statistics: after each word the state, and the length of the longest run that ends there."""
        v = n = 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            to = self.next[v].get(w)
            v, n = (0, 0) if to is None else (to, n + 1)
            yield v, n

    def places(self, v: int) -> list[tuple[int, int]]:
        """Every (text, index of the last word) where a state's runs stand."""
        got = self._places.get(v)
        if got is None:
            got, heap = [], [v]
            while heap:
                u = heap.pop()
                got += self.own[u]
                heap += self.children[u]
            got.sort()
            self._places[v] = got
        return got


def words_of(text: str | None) -> list[bytes]:
    """The words of one text."""
    out: list[bytes] = []
    for _, _, data, offsets in scan.pieces(pa.array([text], pa.string())):
        w = Words(data, offsets)
        out += [w.bytes[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    return out


class Scanner:
    """What one batch after the other is scanned with."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], least: int, gap: int, share: float):
        self.least, self.gap, self.share = least, gap, share
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for label, _ in phrases]
        texts = [words_of(t) for _, t in templates]
        short = [words_of(t) for _, t in phrases]
        if any(len(x) < 2 for x in short):
            raise ValueError("a phrase has two words at least")
        if sum(map(len, texts)) + sum(map(len, short)) > TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {TEMPLATE_WORDS} words: scan with a part of them at a time")
        self.sizes = [len(x) for x in texts]
        self.automaton = Automaton(texts + short)
        self.phrase_sizes = [len(x) for x in short]
        #: Phrases that end a state's runs; those of the state's own class only if the run is long enough.
        self.ending: list[tuple[int, ...]] = [()] * len(self.automaton.link)
        at: dict[int, list[int]] = {}
        for p, x in enumerate(short):
            at.setdefault(self.automaton.find(x), []).append(p)
        for v in np.argsort(self.automaton.length, kind="stable").tolist()[1:]:
            self.ending[v] = tuple(at.get(v, ())) + self.ending[self.automaton.link[v]]
        hashes: dict[bytes, int] = {}
        for _, _, data, offsets in scan.pieces(pa.array([t for _, t in [*templates, *phrases]], pa.string()), 1 << 40):
            w = Words(data, offsets)
            for h, a, b in zip(w.hash.tolist(), w.start.tolist(), w.end.tolist(), strict=True):
                hashes[w.bytes[a:b]] = h
        self.hash = np.array(sorted(hashes.values()), np.uint64)
        vocabulary = {x: int(np.searchsorted(self.hash, np.uint64(h))) for x, h in hashes.items()}
        pairs = {(vocabulary[a], vocabulary[b]) for x in texts + short for a, b in zip(x, x[1:], strict=False)}
        hot = {(vocabulary[a], vocabulary[b]) for x in short for a, b in zip(x, x[1:], strict=False)}
        code = lambda x: np.array(sorted(a * len(self.hash) + b for a, b in x), np.int64)
        self.pairs, self.hot = code(pairs), code(hot)

    def stretches(self, words: Words) -> list[tuple[int, int]]:
        """First and last word of every stretch of known pairs that can hold a phrase or a match."""
        if len(words.hash) < 2 or not len(self.hash):
            return []
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        known = self.hash[at] == words.hash
        left = np.flatnonzero(known[:-1] & known[1:] & (words.row[:-1] == words.row[1:]))
        code = at[left] * len(self.hash) + at[left + 1]
        left, code = left[_in(code, self.pairs)], code[_in(code, self.pairs)]
        if not len(left):
            return []
        cut = np.flatnonzero(np.diff(left, prepend=-9) != 1)
        last = np.append(cut[1:], len(left)) - 1
        hot = np.add.reduceat(_in(code, self.hot).astype(np.int64), cut) > 0
        keep = hot | (last - cut + 2 >= self.least)
        return list(zip(left[cut[keep]].tolist(), (left[last[keep]] + 1).tolist(), strict=True))

    def scan(self, words: Words, rows: int) -> tuple[list[list[dict]], list[list[dict]]]:
        """Each row's phrases (label, first word, last word) and spans."""
        begin = np.searchsorted(words.row, np.arange(rows)).tolist()
        base: list[list[dict]] = [[] for _ in range(rows)]
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in self.stretches(words):
            r = int(words.row[a])
            own = [words.bytes[x:y] for x, y in zip(words.start[a : b + 1].tolist(), words.end[a : b + 1].tolist(), strict=True)]
            where, before = a - begin[r], (0, 0)
            for i, (v, n) in enumerate(self.automaton.stream(own)):
                for p in self.ending[v]:
                    if n >= self.phrase_sizes[p]:
                        base[r].append({"label": self.phrase_labels[p], "first": where + i - self.phrase_sizes[p] + 1, "last": where + i})
                if n <= before[1] and before[1] >= self.least:
                    matches.setdefault(r, []).append((where + i - 1, *before))
                before = (v, n)
            if before[1] >= self.least:
                matches.setdefault(r, []).append((where + len(own) - 1, *before))
        spans: list[list[dict]] = [[] for _ in range(rows)]
        for r, found in matches.items():
            spans[r] = self.chained(found)
        return base, spans

    def chained(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """The spans of one text's matches (last word, state, length)."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, v, n in matches:
            for t, to in self.automaton.places(v):
                if t < len(self.sizes):
                    by.setdefault(t, []).append((end, to, n))
        found = [c for t, own in by.items() if sum(x[2] for x in own) >= self.share * self.sizes[t] for c in self._chains(t, sorted(own))]
        found.sort(key=lambda c: (-c["covered"], -c["share"], c["template"], c["first"]))
        taken: list[tuple[int, int]] = []  # apart from each other, in order
        out = []
        for c in found:
            a, b = c["first"], c["last"]
            lo = bisect_left(taken, (a, 0))
            lo -= lo > 0 and taken[lo - 1][1] >= a
            hi = bisect_left(taken, (b + 1, 0), lo)
            shared = sum(min(y, b) - max(x, a) + 1 for x, y in taken[lo:hi])
            if 2 * shared <= b - a + 1:
                out.append(c)
                taken[lo:hi] = [(min([a, *(x for x, _ in taken[lo:hi])]), max([b, *(y for _, y in taken[lo:hi])]))]
        return sorted(out, key=lambda c: (c["first"], c["last"], c["template"]))

    def _chains(self, t: int, own: list[tuple[int, int, int]]) -> Iterator[dict]:
        """The best chains of a template, each of places that no better chain has. own: (last word, last template word, length)."""
        best, back = [n for _, _, n in own], [-1] * len(own)
        for j, (end, to, n) in enumerate(own):
            for i in range(j - 1, -1, -1):
                e, f, _ = own[i]
                if end - n - e > self.gap:
                    break
                fresh = min(n, end - e, to - f)  # words beyond the other's, in the text and in the template
                if fresh > 0 and to - n - f <= self.gap and best[i] + fresh > best[j]:
                    best[j], back[j] = best[i] + fresh, i
        used = [False] * len(own)
        for j in sorted(range(len(own)), key=lambda j: (-best[j], j)):
            path, k = [], j
            while k >= 0 and not used[k]:
                path.append(k)
                k = back[k]
            if not path or used[path[0]]:
                continue
            covered = best[j] - (best[k] if k >= 0 else 0)
            for i in path:
                used[i] = True
            if covered >= self.share * self.sizes[t]:
                first = path[-1]
                yield {
                    "label": self.labels[t], "template": t, "first": own[first][0] - own[first][2] + 1, "last": own[j][0],
                    "template_first": own[first][1] - own[first][2] + 1, "template_last": own[j][1], "covered": covered, "share": covered / self.sizes[t],
                }


def _in(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


_PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
_SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("template_first", pa.int64()), ("template_last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    phrases: list[tuple[str, str]] | None = None,
    least: int = LEAST,
    gap: int = GAP,
    share: float = SHARE,
) -> DataFrame:
    """One row per document: id, n_words long, base (its phrases' places), spans (covered template spans), score double.

    base array<struct<label, first, last>>, in order of their ends; spans array<struct<label, template, first, last,
    template_first, template_last, covered, share>>. Words are numbered from 0, templates by their place in the list.
    """
    ready(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, least, gap, share)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scanner))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for batch in batches:
            for at, to, data, offsets in scan.pieces(batch.column("text")):
                words = Words(data, offsets)
                base, spans = own.scan(words, to - at)
                score = [1.0 if b else max((x["share"] for x in s), default=0.0) for b, s in zip(base, spans, strict=True)]
                cols = [batch.column("id").slice(at, to - at), pa.array(np.bincount(words.row, minlength=to - at), pa.int64()), pa.array(base, pa.list_(_PLACE)), pa.array(spans, pa.list_(_SPAN)), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "base", "spans", "score"])

    return narrow.mapInArrow(
        work,
        f"id {dict(narrow.dtypes)['id']}, n_words bigint, base array<struct<label: string, first: bigint, last: bigint>>, "
        "spans array<struct<label: string, template: int, first: bigint, last: bigint, template_first: bigint, template_last: bigint, covered: bigint, share: double>>, score double",
    )

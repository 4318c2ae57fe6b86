"""SentencePiece encoding and decoding (models of the merge kind) by backtracking.

The encoding of a stretch of text is the one sequence of pieces in which every two neighbours are what
merging their joined characters would give again. It is found greedily:

* one Aho-Corasick pass lists, for each place, the pieces that begin there, longest first;
* the longest is taken if the place after it isn't known to fail and it is compatible with the piece before,
  which is checked by re-merging the two (the answers are remembered);
* otherwise the next shorter one; when none is left, the place is marked in a bitfield as failed, and the
  piece before is taken back.

Text is first cut where no piece can reach across: between two characters that stand side by side in no
piece. Digests are made of many texts at once: each different stretch of a few megabytes of text is encoded
once (and remembered in a bounded table, since words repeat), and Arrow copies the results to its places.

Characters outside the vocabulary become their UTF-8 byte pieces. Models that normalise text, and models
without byte pieces, are refused rather than encoded wrongly.

Defined results. A null text counts as empty: no ids, and empty decoded text. A text of any length is
encoded whole. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import scan
from tessella.llm.shared import ready

SPACE = "▁"
#: Bytes of text of which each different stretch is looked up once.
DIGEST_PIECE = 4 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """The pieces and settings of a serialised SentencePiece model."""

    def __init__(self, data: bytes):
        import struct

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.prefix, self.strip, self.charsmap, self.byte_fallback, self.kind = True, True, b"", False, 1
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                self.pieces.append(got.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif field == 2:
                got = dict(_fields(value))
                self.kind, self.byte_fallback = got.get(3, 1), bool(got.get(35, 0))
            elif field == 3:
                got = dict(_fields(value))
                self.charsmap = got.get(2, b"")
                self.prefix, self.strip = bool(got.get(3, 1)), bool(got.get(4, 1))
        if self.kind != 2 or not self.byte_fallback or self.charsmap or self.strip or USER in self.kinds:
            raise ValueError("only merge models with byte pieces and without normalisation are encoded here")


class Tokenizer:
    """Encodes and decodes with one model. ``remember`` bounds its tables: the last so many words, twice, and pairs of pieces."""

    def __init__(self, data: bytes, remember: int = 1 << 17):
        model = self.model = Model(data)
        self.ids = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if model.prefix and SPACE not in self.ids:
            raise ValueError("a model that adds a space before texts needs a piece for it")
        self._names = [b",%d" % i for i in range(len(model.pieces))]
        self._parts = [self._piece_bytes(i) for i in range(len(model.pieces))]
        self.side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.remember = remember
        self._pairs: dict[tuple[str, str], bool] = {}
        made = {p for p in self.ids if self.merge(p) == [p]}  # others are never the result of merging
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}  # the longest piece that a piece begins with
        for p in made:
            self.automaton.add_word(p, (len(p), p))
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in made), "")
        self.automaton.make_automaton()
        self._known: dict[bytes, tuple[int, bytes, bytes]] = {}
        self._older: dict[bytes, tuple[int, bytes, bytes]] = {}
        # Cutting by a pattern is only right if pieces join words nowhere.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lone = [c for c in "\n\t\r" if not any(c in x for x in self.side)]
        cls = "".join(map(re.escape, lone))
        self.cut = None if inner else re.compile(f"{SPACE}*[^{SPACE}{cls}]+" + (f"|[{cls}]" if cls else "") + f"|{SPACE}+")
        self.lone = np.zeros(256, bool)
        self.lone[list(map(ord, lone))] = True
        #: Whether two ASCII bytes side by side may be in one piece; other bytes may.
        self.near = np.ones((256, 256), bool)
        self.near[:128, :128] = False
        for pair in self.side:
            a, b = (32 if c == SPACE else ord(c) for c in pair)
            if max(a, b) < 128 and " " not in pair:
                self.near[a, b] = True

    # -- encoding

    def merge(self, text: str) -> list[str]:
        """What repeated merging makes of the characters: the best-scored pair first, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.model.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) >= 3 * self.remember:
                self._pairs.clear()
            got = self._pairs[key] = left[-1] + right[0] not in self.side or self.merge(left + right) == [left, right]
        return got

    def backtrack(self, text: str) -> list[str]:
        """The pieces of one stretch; characters outside the vocabulary stand alone."""
        n, pairs, shorter = len(text), self._pairs, self.shorter
        longest = list(text)
        for end, (length, piece) in self.automaton.iter(text):
            longest[end - length + 1] = piece  # longer ones end, and so come, later
        failed: bytearray | None = None  # one bit for each place, made when the first one fails
        pos, last = 0, ""
        out: list[str] = []
        piece = longest[0]
        while pos < n:
            while piece:
                to = pos + len(piece)
                if failed is None or not failed[to >> 3] >> (to & 7) & 1:
                    if not last:
                        break
                    good = pairs.get((last, piece))
                    if self.compatible(last, piece) if good is None else good:
                        break
                piece = shorter.get(piece, "")
            if piece:
                out.append(piece)
                pos += len(piece)
                last = piece
                if pos < n:
                    piece = longest[pos]
            else:
                if not out:
                    raise AssertionError(f"no encoding of {text!r}")
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                back = out.pop()
                pos -= len(back)
                last = out[-1] if out else ""
                piece = shorter.get(back, "")
        return out

    def stretch(self, text: str) -> list[int]:
        pieces = self.backtrack(text)
        ids = list(map(self.ids.get, pieces))
        if None in ids:
            return [k for i, piece in zip(ids, pieces, strict=True) for k in ([self.bytes[b] for b in piece.encode()] if i is None else [i])]
        return ids  # type: ignore[return-value]

    def stretches(self, text: str) -> list[str]:
        """The normalised text, cut where no piece reaches across."""
        return self._between((SPACE * self.model.prefix + text).replace(" ", SPACE)) if text else []

    def _between(self, text: str) -> list[str]:
        if self.cut is not None:
            return self.cut.findall(text)
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.side]
        return [text[a:b] for a, b in pairwise([0, *cuts, len(text)])] if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.stretches(text) for i in self.stretch(s)]

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of any ids. The prefix's space goes, if the first piece (not a byte) has it."""
        first = next((i for i in ids if self.model.kinds[i] != CONTROL), None)
        drop = self.model.prefix and first is not None and self.model.kinds[first] == NORMAL and self.model.pieces[first].startswith(SPACE)
        return self._text(b"".join(map(self._parts.__getitem__, ids)), drop)

    def _piece_bytes(self, i: int) -> bytes:
        """A piece's UTF-8 text. Byte pieces stay single bytes."""
        kind = self.model.kinds[i]
        if kind == BYTE:
            return bytes([self.byte_of[i]])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return self.model.pieces[i].replace(SPACE, " ").encode()

    def _text(self, data: bytes, drop: bool) -> str:
        """The bytes as text; each byte of no valid character becomes U+FFFD; ``drop``: but for the first."""
        data = data[drop:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return "".join(_lenient(data))

    # -- whole texts

    def _of(self, stretch: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids each with a comma before, their decoded bytes, of one stretch with its spaces as they were."""
        got = self._known.get(stretch)
        if got is not None:
            return got
        got = self._older.get(stretch)
        if got is None:
            ids = self.stretch(stretch.decode().replace(" ", SPACE))
            got = len(ids), b"".join(map(self._names.__getitem__, ids)), b"".join(map(self._parts.__getitem__, ids))
        if len(stretch) <= 64:
            if len(self._known) >= self.remember:
                self._older, self._known = self._known, {}  # words in use come back from there
            self._known[stretch] = got
        return got

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the stretches of a piece's texts begin, and its end: :attr:`cut`, and more cuts between ASCII characters."""
        space, lone = data == 32, self.lone[data]
        begin = lone.copy()
        begin[1:] |= lone[:-1] | space[1:] & ~space[:-1] | ~self.near[data[:-1], data[1:]]
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.append(np.flatnonzero(begin), len(data))

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Of each text the number of ids, SHA-256 of the ids, SHA-256 of their decoded text."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), SPACE, " ")
        if self.model.prefix:
            space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
            texts = pc.if_else(pc.equal(texts, none), texts, pc.binary_join_element_wise(space, texts, none))
        total, ids_hash, text_hash = np.zeros(len(texts), np.int64), [], []
        for first, to, data, offsets in scan.pieces(texts, DIGEST_PIECE):
            if self.cut is not None:
                cuts = self._cuts(data, offsets)
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
            else:
                own = [[s.replace(SPACE, " ").encode() for s in self._between(data[a:b].tobytes().decode().replace(" ", SPACE))] for a, b in pairwise(offsets.tolist())]
                parts = pa.array([s for x in own for s in x], pa.large_binary())
                cuts = np.cumsum([0, *(len(s) for x in own for s in x)])
            coded = parts.dictionary_encode()
            which = coded.indices
            found = [self._of(s) for s in coded.dictionary.to_pylist()]
            counts, names, decoded = zip(*found, strict=True) if found else ((), (), ())
            at = np.searchsorted(cuts[:-1], offsets)  # each text's first stretch
            sums = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[which.to_numpy()])])
            total[first:to] = np.diff(sums[at])
            for values, out, digest in ((names, ids_hash, self._ids_digest), (decoded, text_hash, self._text_digest)):
                spread = pa.array(values, pa.large_binary()).take(which)
                _, ends, whole = spread.buffers()
                ends = np.frombuffer(ends, np.int64)[at].tolist() if len(spread) else [0] * len(at)
                view = memoryview(whole) if whole is not None else memoryview(b"")
                out += [digest(view[a:b]) for a, b in pairwise(ends)]
        return total, ids_hash, text_hash

    @staticmethod
    def _ids_digest(names: memoryview) -> str:
        return hashlib.sha256(names[1:]).hexdigest()

    def _text_digest(self, data: memoryview) -> str:
        """Of the decoded bytes of one text. The prefix's space, with which every text begins, goes."""
        data = data[self.model.prefix :]
        try:
            str(data, "utf-8")
        except UnicodeDecodeError:
            return hashlib.sha256(self._text(data.tobytes(), False).encode()).hexdigest()
        return hashlib.sha256(data).hexdigest()

    def digest(self, text: str) -> tuple[int, str, str]:
        """The digests of one text."""
        total, ids_hash, text_hash = self.digests(pa.array([text]))
        return int(total[0]), ids_hash[0], text_hash[0]


def _lenient(data: bytes) -> Iterator[str]:
    at = 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                yield data[at : at + n].decode()
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            at += 1


_built: dict[str, Tokenizer] = {}


def tokenizer_of(data: bytes) -> Tokenizer:
    """The tokenizer of a model, with what it remembers kept while the worker process lives."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Tokenizer(data)
    return _built[key]


def _run(docs: DataFrame, id_col: str, text_col: str, model: bytes, columns: str, made) -> DataFrame:
    """``made`` turns a tokenizer and an array of texts into Arrow columns by name."""
    spark = docs.sparkSession
    ready(spark)
    kept = spark.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = dict(narrow.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(kept.value)
        for batch in batches:
            got = made(tokenizer, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *got.values()], ["id", *got])

    return narrow.mapInArrow(work, f"id {kind}, {columns}")


def _ids(tokenizer: Tokenizer, texts: pa.Array) -> dict[str, pa.Array]:
    ids = [tokenizer.encode(x) for x in texts.to_pylist()]
    return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([tokenizer.decode(x) for x in ids], pa.string())}


def _digests(tokenizer: Tokenizer, texts: pa.Array) -> dict[str, pa.Array]:
    total, ids_hash, text_hash = tokenizer.digests(texts)
    return {"n_tokens": pa.array(total), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded string: every whole text's ids and what they decode to."""
    return _run(docs, id_col, text_col, model, "ids array<int>, decoded string", _ids)


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: the same encoding, of which only digests leave the workers."""
    return _run(docs, id_col, text_col, model, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)

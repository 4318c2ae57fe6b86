"""Language ID with hyperdimensional profiles.

Every character has a fixed random vector of +1 and -1. A trigram's vector binds (multiplies) its letters'
vectors, each rotated by its place; a text's profile bundles (adds) the vectors of its trigrams. A language's
prototype is the sum of the normalised profiles of the documents it learns from. A text gets the language
whose prototype has the largest cosine with its profile; a tie goes to the first name in order.

Trigrams run over the lower-cased letters of a text, each run of other characters being one space, with a
space at either end. Characters' vectors come from a seeded hash of the code point, so no alphabet is fixed
and none is learnt.

Learning uses rows with a language whose ``held_out`` remainder is not 0, ``train_rows`` of each language at
most in expectation, chosen by a hash of the id; each task adds up its own share of each prototype, so what
is brought to the driver is one vector a language.

Defined results. Null texts and texts without a letter are ``und`` with score 0. The score is the cosine, at
least 0. Rows with a null language are not learnt from. Repeated rows are judged one by one. If nothing can
be learnt every text is ``und``. Whole texts are read, whatever their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import held_out, ready

SIZE, SEED = 2048, 8
#: Documents of each language that the prototypes learn from, in expectation.
TRAIN_ROWS = 2_000
#: Languages there may be: their prototypes are held by the driver and sent to every task.
LANGUAGES = 10_000
#: Texts whose profiles are made at once.
CHUNK = 256

_NOT_LETTER = np.iinfo(np.uint32).max


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _random(points: np.ndarray) -> np.ndarray:
    """(points, SIZE) of +1 and -1, from a counter-based hash of seed, code point and place."""
    x = points.astype(np.uint64)[:, None] * np.uint64(SIZE // 64) + np.arange(SIZE // 64, dtype=np.uint64) + np.uint64(SEED << 40)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class Profiles:
    """Text profiles. The vectors of the trigrams seen are kept, up to a bound, whatever their script. A trigram is its three code points in one number."""

    KEPT, BITS = 1 << 14, 21

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.codes, self.row = np.empty(0, np.int64), np.empty(0, np.int64)  # of the kept trigrams, in order
        self.bound = np.empty((1024, SIZE), np.int8)
        self.kept = 0

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigrams, from those of their letters."""
        three = np.stack([codes >> 2 * self.BITS, codes >> self.BITS & (1 << self.BITS) - 1, codes & (1 << self.BITS) - 1])
        letters, at = np.unique(three, return_inverse=True)
        v, (a, b, c) = _random(letters), at.reshape(three.shape)
        return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]

    def _trigrams(self, text: str | None) -> np.ndarray | None:
        """The trigrams of letters and gaps, with a gap at either end; None without a letter."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[points]
        if not letter.any():
            return None
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first character after a run of letters stands for the gap
        points = np.where(letter, points, 32)[keep].astype(np.int64)
        # Gaps and both ends are one space each.
        points = np.concatenate([[32], points, [32]] if points[-1] != 32 else [[32], points])
        return (points[:-2] << self.BITS | points[1:-1]) << self.BITS | points[2:]

    def of(self, text: str | None) -> np.ndarray | None:
        """The profile of one text; None without a letter."""
        return next(iter(self.of_all([text]).values()), None)

    def of_all(self, texts: list[str | None]) -> dict[int, np.ndarray]:
        """The profiles of the texts that have a letter, by their position: counts of trigrams times the trigrams' vectors."""
        out: dict[int, np.ndarray] = {}
        found = {k: x for k, text in enumerate(texts) if (x := self._trigrams(text)) is not None}
        whose, codes = list(found), list(found.values())
        # As many texts at once as have no more different trigrams than are kept.
        while codes:
            n = len(codes)
            while len(new := np.unique(np.concatenate(codes[:n]))) > self.KEPT and n > 1:
                n = (n + 1) // 2
            if len(new) > self.KEPT:
                out[whose[0]] = self._long(codes[0])
            else:
                for k, profile in zip(whose[:n], self._bundled(codes[:n], new), strict=True):
                    out[k] = profile
            codes, whose = codes[n:], whose[n:]
        return out

    def _known(self, codes: np.ndarray) -> np.ndarray:
        """Which trigrams are kept."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        return self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)

    def _bundled(self, codes: list[np.ndarray], different: np.ndarray) -> np.ndarray:
        new = different[~self._known(different)]
        if self.kept + len(new) > self.KEPT:
            self._clear()
            new = different
        if len(new):
            to = self.kept + len(new)
            if to > len(self.bound):
                more = np.empty((max(to, min(self.KEPT, 2 * len(self.bound))), SIZE), np.int8)
                more[: self.kept] = self.bound[: self.kept]
                self.bound = more
            for k in range(0, len(new), 4096):
                self.bound[self.kept + k : min(to, self.kept + k + 4096)] = self._bind(new[k : k + 4096])
            where = np.searchsorted(self.codes, new)
            self.codes, self.row = np.insert(self.codes, where, new), np.insert(self.row, where, np.arange(self.kept, to))
            self.kept = to
        # Trigrams by their position among those that occur here.
        own = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
        at = np.searchsorted(different, np.concatenate(codes))
        counts = np.bincount(own * len(different) + at, minlength=len(codes) * len(different)).reshape(len(codes), -1)
        return counts.astype(np.float32) @ self.bound[self.row[np.searchsorted(self.codes, different)]].astype(np.float32)

    def _long(self, codes: np.ndarray) -> np.ndarray:
        """For a text with more different trigrams than are kept: their vectors are made anew, so many at a time."""
        codes, counts = np.unique(codes, return_counts=True)
        out = np.zeros(SIZE, np.float32)
        for k in range(0, len(codes), 4096):
            out += counts[k : k + 4096].astype(np.float32) @ self._bind(codes[k : k + 4096]).astype(np.float32)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.linalg.norm(x)), 1e-12)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, out: Column | None = None) -> dict[str, np.ndarray]:
    """A prototype per language. ``out``: rows not to learn from (default: the held-out fifth)."""
    ready(docs.sparkSession)
    out = held_out(id_col) if out is None else out
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~out)
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(train_rows) / F.count(F.lit(1))).alias("share"))
    if shares.limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(), {}
        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), CHUNK):
                for k, got in profiles.of_all(texts[at : at + CHUNK]).items():
                    name = names[at + k]
                    sums[name] = sums.get(name, 0) + _unit(got).astype(np.float64)
        for name, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * SIZE), pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(x)], ["lang", "at", "x"])

    parts = rows.mapInArrow(work, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum(F.round(F.col("x") * (1 << 30)).cast("long")).alias("x"))
    found: dict[str, np.ndarray] = {}
    for name, at, x in parts.collect():  # SIZE numbers a language; sums of integers, so their order doesn't matter
        found.setdefault(name, np.zeros(SIZE))[at] = x
    return {k: _unit(found[k]) for k in sorted(found)}


class Model:
    """Prototypes as one matrix, and their languages in order."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.names = list(prototypes)
        self.matrix = np.array([prototypes[k] for k in self.names], np.float32).reshape(len(self.names), SIZE)

    def predict(self, profiles: Profiles, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and cosine of each text."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts) if self.names else 0, CHUNK):
            for k, got in profiles.of_all(texts[at : at + CHUNK]).items():
                cosine = self.matrix @ _unit(got)
                best = int(np.argmax(cosine))
                names[at + k], scores[at + k] = self.names[best], min(1.0, max(0.0, float(cosine[best])))
        return names, scores


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    spark = docs.sparkSession
    ready(spark)
    kept = spark.sparkContext.broadcast(Model(prototypes))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, model = Profiles(), kept.value
        for batch in batches:
            lang, score = model.predict(profiles, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return narrow.mapInArrow(work, f"id {dict(narrow.dtypes)['id']}, lang_pred string, score double")


def drop_rejected(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose predicted language isn't ``und``."""
    spark = docs.sparkSession
    ready(spark)
    kept = spark.sparkContext.broadcast(Model(prototypes))
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, model = Profiles(), kept.value
        for batch in batches:
            yield batch.filter(pa.array([x != "und" for x in model.predict(profiles, batch.column(at).to_pylist())[0]], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)

import random
import re

import pyarrow as pa
import pytest

from tessella.llm import licences
from tessella.llm.decontaminate import Words
from tessella.llm.licence_texts import PHRASES, TEMPLATES
from tessella.llm.licences import Automaton, Scanner, scan_licences, words_of
from tessella.llm.scan import pieces

DOCS = "doc_id long, text string, id string, base int, spans string, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text, phrases=PHRASES):
    w = words(text)
    return sorted((label, i) for label, p in phrases for i in range(len(w)) if w[i : i + len(words(p))] == words(p))


def test_automaton_gives_matching_statistics():
    r = random.Random(1)
    for seed in range(30):
        texts = [[r.choice(b"abc"[: r.randint(1, 3)].decode()).encode() for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 4))]
        texts += texts[:1]
        a = Automaton(texts)
        line = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        for i, (v, n) in enumerate(a.stream(line)):
            ends = lambda m: sorted((t, k + m - 1) for t, x in enumerate(texts) for k in range(len(x) - m + 1) if x[k : k + m] == line[i - m + 1 : i + 1])  # noqa: B023, E731
            longest = max((m for m in range(1, i + 2) if ends(m)), default=0)
            assert n == longest, seed
            if n:
                assert a.places(v) == ends(n)
                assert a.length[a.link[v]] < n <= a.length[v]


def scanned(spark, rows, **options):
    d = spark.createDataFrame([(i, t, "q", 1, "s", "x") for i, t in rows], DOCS).repartition(3)
    return scan_licences(d, **options).collect()


def test_phrases_are_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["GNU", "general", "public", "License", "apache", "CC", "by", "MIT", "x", "é"]
    seps = [" ", ", ", "\n", "-", "  "]
    rows = [(i, "".join(r.choice(vocabulary) + r.choice(seps) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "!!"), (402, "MIT License"), (None, "cc-by cc by"), (403, "mit licence, mit licenses"), (404, "GNU\tGeneral\nPublic LICENSE " * 30_000)]
    got = scanned(spark, rows)
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len(words(t)), base(t)) for i, t in rows)
    assert sorted((-1 if x.id is None else x.id, x.n_words, sorted((b.label, b.first) for b in x.base)) for x in got) == want
    assert all(x.score == (1.0 if x.base else max([s.share for s in x.spans], default=0.0)) for x in got)
    assert scan_licences(spark.createDataFrame([], DOCS)).count() == 0


def test_overlapping_and_nested_phrases(spark):
    phrases = [("aa", "a a"), ("aaa", "A a a"), ("ab", "a b"), ("other", "a b")]
    text = "a a a b a a"
    (got,) = scanned(spark, [(1, text)], phrases=phrases, templates=[])
    assert sorted((b.label, b.first) for b in got.base) == base(text, phrases)
    assert got.spans == []
    with pytest.raises(ValueError):
        scan_licences(spark.createDataFrame([], DOCS), phrases=[("one", "word")])


def test_every_template_is_found_whole(spark):
    rows = [(k, f"some code here {t} and more words") for k, (_, t) in enumerate(TEMPLATES)]
    for x in scanned(spark, rows):
        label, text = TEMPLATES[x.id]
        assert [(s.label, s.template, s.first, s.last) for s in x.spans] == [(label, x.id, 3, 2 + len(words(text)))], label
        assert x.spans[0].share == 1.0 and x.score == 1.0
        assert (x.spans[0].template_first, x.spans[0].template_last) == (0, len(words(text)) - 1)


def damaged(text, r, share):
    w = words(text)
    for _ in range(int(len(w) * share)):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([[], ["zzz"], [w[k], "yyy"]])
    return " ".join(w)


def test_damaged_templates_are_found_and_parts_are_not(spark):
    r = random.Random(3)
    rows = [(k, f"first words {damaged(t, r, 0.04)} last words") for k, (_, t) in enumerate(TEMPLATES) for _ in range(3)]
    for x in scanned(spark, rows):
        assert TEMPLATES[x.id][0] in {s.label for s in x.spans}, TEMPLATES[x.id]
        assert all(0 <= s.first <= s.last < x.n_words and licences.SHARE <= s.share <= 1 for s in x.spans)
    halves = [(k, t[: len(t) // 3]) for k, (_, t) in enumerate(TEMPLATES) if len(words(t)) > 60]
    assert all(not s.spans for s in scanned(spark, halves))
    prose = [(1, "the use of this software is subject to the terms of the agreement and any person may use it for any purpose " * 40)]
    assert scanned(spark, prose)[0].spans == []


def test_copies_in_one_text_are_spans_of_their_own():
    mit, zlib = TEMPLATES[0][1], next(t for label, t in TEMPLATES if label == "zlib")
    own = Scanner(TEMPLATES, PHRASES, licences.LEAST, licences.GAP, licences.SHARE)
    text = f"{mit} {mit}\n{zlib} x {mit}"
    (_, _, data, offsets), *_ = pieces(pa.array([text]))
    (found,) = own.scan(Words(data, offsets), 1)[1]
    assert [s["label"] for s in found] == ["mit", "mit", "zlib", "mit"]
    n, z = len(words(mit)), len(words(zlib))
    assert [s["first"] for s in found] == [0, n, 2 * n, 2 * n + z + 1]


def test_stretches_skip_nothing():
    """Scanning the stretches of known pairs gives what scanning every word gives."""
    own = Scanner(TEMPLATES, PHRASES, 2, licences.GAP, 0.02)
    r = random.Random(4)
    pool = [w.decode() for _, t in TEMPLATES for w in words_of(t)]
    text = ""
    for _ in range(400):
        k = r.randrange(len(pool) - 6)
        text += " ".join(pool[k : k + r.choice([1, 1, 2, 4, 6])]) + " "
    (_, _, data, offsets), *_ = pieces(pa.array([text]))
    w = Words(data, offsets)
    got = own.scan(w, 1)
    own.stretches = lambda words: [(0, len(words.hash) - 1)]
    assert got == own.scan(w, 1)
    assert got[1][0]

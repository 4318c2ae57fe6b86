import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm.exact_dedup import drop_copies, exact_dedup, heavy_winners, digests
from tessella.llm.line_dedup import clean_texts, line_dedup

DOCS = "doc_id long, text string, id string, row int, fp string, line string, pos int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 2) for i, t in rows], DOCS)


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


@pytest.mark.parametrize("least", [1, 3, 64])
def test_exact_dedup(spark, least):
    rows = [(i, f"t{i % 7}") for i in range(40)] + [(50, None), (51, ""), (52, "x" * 100_000), (53, "T1")]
    got = exact_dedup(docs(spark, rows).repartition(3), least=least, counters=64).collect()
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        own = want[next(t or "" for i, t in rows if i == r.id)]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.id == max(own))
    text = {i: t or "" for i, t in rows}
    assert all(r.text_sha256 == hashlib.sha256(text[r.id].encode()).hexdigest() for r in got)


def test_exact_dedup_ties_nulls_and_empty_tables(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    got = exact_dedup(docs(spark, rows)).collect()
    assert sorted((r.id or 0, r.kept) for r in got).count((1, True)) == 1
    assert sum(r.kept for r in got) == 3 and {r.keep_id for r in got if r.text_sha256 == hashlib.sha256(b"b").hexdigest()} == {None}
    assert exact_dedup(docs(spark, [])).count() == 0
    kept = drop_copies(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "b"), (1, "a"), (2, "c")]


def test_heavy_digests_are_bounded_and_right(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(600)]
    heavy = heavy_winners(digests(docs(spark, rows)), least=50, counters=16).collect()
    assert len(heavy) == 1 and heavy[0].group_size == 400 and heavy[0].top.id == 599


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a[:i] == b[:i] and a[i + (len(a) == len(b)) :] == b[i + 1 :] for i in range(len(b)))


def brute_lines(rows):
    lines = [((i, n), x) for i, t in sorted(rows) for n, x in enumerate((t or "").split("\n"))]
    first, out = {}, {}
    for at, x in lines:
        if x:
            first.setdefault(x, at)
    for at, x in lines:
        if not x:
            out[at] = (True, at, 0)
            continue
        near = min((p for y, p in first.items() if p < first[x] and one_edit(x, y)), default=None)
        keep = first[x] if near is None else near
        out[at] = (keep == at, keep, 0 if near is None else 1)
    return out


def check_lines(spark, rows):
    got = {(r.id, r.line_no): (r.kept, (r.keep_id, r.keep_line_no), r.distance) for r in line_dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_cases(spark):
    base = "the quick brown fox jumps over the lazy dog"
    rows = [(5, base), (3, base + "!\nx"), (9, "the quick brown fox jumpz over the lazy dog\n\n"), (11, "quick brown\na\nb\nab\né\né1"), (12, None), (13, ""), (14, base[1:]), (20, "w" * 5000), (21, "w" * 2500 + "v" + "w" * 2499), (22, "w" * 4999)]
    check_lines(spark, rows)


def test_line_dedup_is_brute_force(spark):
    r = random.Random(7)
    check_lines(spark, [(i, "".join(r.choice("aabé\n") for _ in range(r.randint(0, 14)))) for i in range(80)])


def test_line_dedup_nulls_and_clean_texts(spark):
    got = line_dedup(docs(spark, [(None, "abc"), (4, "abcd\nabc")])).orderBy(F.col("id").asc_nulls_last(), "line_no").collect()
    assert [(r.id, r.kept, r.keep_id) for r in got] == [(4, True, 4), (4, False, 4), (None, False, 4)]
    assert line_dedup(docs(spark, [])).count() == 0
    texts = {r.id: r.text for r in clean_texts(docs(spark, [(1, "aa\nbb\n\naa"), (2, "bb\ncc"), (3, None)])).collect()}
    assert texts == {1: "aa\nbb\n", 2: "cc", 3: ""}


def test_line_dedup_repeated_rows_and_other_ids(spark):
    rows = [(1, "one line here\nxx"), (1, "one line here\nxx"), (2, "other\none line hera")]
    got = line_dedup(docs(spark, rows)).collect()
    assert sorted((r.id, r.line_no, r.kept) for r in got) == [(1, 0, False), (1, 0, True), (1, 1, False), (1, 1, True), (2, 0, True), (2, 1, False)]
    named = spark.createDataFrame([("b", "same line"), ("a", "same line\nother"), (None, "same line")], "doc_id string, text string")
    got = {(r.id, r.line_no): (r.kept, r.keep_id) for r in line_dedup(named).collect()}
    assert got == {("a", 0): (True, "a"), ("a", 1): (True, "a"), ("b", 0): (False, "a"), (None, 0): (False, "a")}
    assert {r.id: r.text for r in clean_texts(named).collect()} == {"a": "same line\nother", "b": "", None: ""}
    assert line_dedup(named.limit(0)).count() == 0


def test_hot_lines_are_dealt_out(spark, monkeypatch):
    from tessella.llm import shared

    monkeypatch.setattr(shared.salted, "__defaults__", (None, 3))
    check_lines(spark, [(i, f"a common line of the site\nown {i} line {i * i}\n" + "abc" * (i % 3)) for i in range(60)])


def test_within_one_is_brute_force(spark, monkeypatch):
    from tessella.llm import line_dedup as module

    r = random.Random(8)
    pairs = []
    for _ in range(300):
        a = "".join(r.choice("abé") for _ in range(r.randrange(9)))
        b = a
        for _ in range(r.choice([1, 1, 2])):
            k = r.randrange(len(b) + 1)
            b = r.choice([b[:k] + r.choice("abé") + b[k:], b[:k] + b[k + 1 :], b[:k] + "x" + b[k + 1 :]])
        if a != b:
            pairs.append((a, b))
    pairs += [("x" * 4000, "x" * 3999), ("x" * 4000, "x" * 3000 + "é" + "x" * 999), ("x" * 4000, "y" + "x" * 3998 + "y"), ("", "a"), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    want = [one_edit(a, b) for a, b in pairs]
    for long in (module.LONG, 0):
        monkeypatch.setattr(module, "LONG", long)
        assert [x.w for x in df.select(module.within_one("a", "b").alias("w")).collect()] == want


def test_long_lines_in_pieces(spark, monkeypatch):
    """Around the length where pieces begin, and a line of which every single deletion would cost far too much at once."""
    from tessella.llm import line_dedup as module

    r = random.Random(5)
    edge = module.LONG * module.BLOCKS
    base = "".join(r.choice("abcdé ") for _ in range(edge + 2))
    rows = []
    for n in (edge - 1, edge, edge + 1, edge + 2):
        for k in (0, 1, n // 3, n // 2, n - 2, n - 1):
            rows += [base[:k] + "X" + base[k + 1 : n], base[:k] + base[k + 1 : n], base[:k] + "Y" + base[k:n]]
    r.shuffle(rows)
    check_lines(spark, list(enumerate(rows)))
    long = "".join(r.choice("abcd ") for _ in range(60_000))
    got = {x.id: x.kept for x in line_dedup(docs(spark, [(1, long), (2, long[:31_000] + "X" + long[31_001:]), (3, long[:-1]), (4, long + "ab"), (5, "q" + long)])).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}
    monkeypatch.setattr(module, "LONG", 1)
    monkeypatch.setattr(module, "CUT", 2)
    check_lines(spark, [(i, "".join(r.choice("aab\n") for _ in range(r.randint(0, 30)))) for i in range(60)])

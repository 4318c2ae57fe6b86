import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import contamination, dedup, masks, metrics, rewards, sampling, samples
from tessella.operators.benchgen import PLAN, generate
from tessella.schemas import SAMPLE

TOOL = json.dumps({"type": "function", "function": {"name": "f", "parameters": {}}})


def m(role, content=None, calls=None, name=None):
    return (role, content, None if calls is None else [(n, a) for n, a in calls], name)


def frame(spark, rows):
    return spark.createDataFrame([(i, "s", msgs, tools) for i, (msgs, tools) in enumerate(rows)], SAMPLE)


def test_validity_reasons(spark):
    u, a = m("user", "q"), m("assistant", "r")
    cases = [
        ([u, a], None, "ok"),
        ([m("system", "s"), u, m("assistant", None, [("f", "{}")]), m("tool", "x", name="f"), a], [TOOL], "ok"),
        ([u], None, "too_few_messages"),
        (None, None, "too_few_messages"),
        ([u, m("robot", "x")], None, "bad_role"),
        ([u, u], None, "missing_user_or_assistant"),
        ([u, a], ['{"type":"x"}'], "bad_tool"),
        ([u, a], ["nonsense"], "bad_tool"),
        ([u, m("assistant", "")], None, "empty_assistant"),
        ([u, m("assistant", None, [])], None, "empty_tool_calls"),
        ([u, m("assistant", None, [("", "{}")])], None, "bad_tool_call"),
        ([u, m("assistant", None, [("f", "[1]")])], None, "bad_tool_call"),
        ([u, a, m("tool", None)], None, "bad_tool_content"),
    ]
    df = frame(spark, [(x, t) for x, t, _ in cases])
    got = [r[0] for r in df.orderBy("sample_id").select(samples.validity()).collect()]
    assert got == [r for *_, r in cases]


def test_kinds_and_cases(spark):
    u, a = m("user", "q"), m("assistant", "r")
    two = m("assistant", None, [("f", "{}"), ("g", "{}")])
    twice = m("assistant", None, [("f", "{}"), ("f", "{}")])
    one = m("assistant", None, [("f", "{}")])
    df = frame(spark, [([u, two], [TOOL]), ([u, twice], None), ([u, a], [TOOL]), ([u, a], []), ([u, one], [TOOL]), ([u], None)])
    assert [r[0] for r in df.orderBy("sample_id").select(samples.kind()).collect()] == ["parallel_diff", "parallel_same", "trap_like", "pure_chat", "ordinary", "pure_chat"]
    cases = {r.id: r for r in samples.to_case(df).collect()}
    assert cases["0"].category == "parallel" and cases["2"].category == "no_tool" and cases["4"].category == "single" and "5" not in cases
    assert cases["4"].expect.calls[0].name == "f" and [x.role for x in cases["4"].messages] == ["user"]
    assert {r.n_calls: r.turns for r in samples.calls_per_turn(df).collect()} == {1: 1, 2: 2}


def test_normalized(spark):
    df = frame(spark, [([m("user", "q"), m("assistant", None, [("f", "[1]"), ("g", "x{"), ("h", '{"a":1}')], "")], None)])
    got = df.select(samples.normalized().alias("x")).first().x[1]
    assert got.content == "" and got.name is None and [c.arguments for c in got.tool_calls] == ['{"value":[1]}', "{}", '{"a":1}']


def test_fill_names(spark):
    rows = [(1, 0, "assistant", "f", None), (1, 1, "tool", None, ""), (1, 2, "tool", None, "own"), (2, 0, "tool", None, None)]
    df = spark.createDataFrame(rows, "c int, t int, role string, call_name string, name string")
    got = samples.fill_tool_names(df, "c", "t").orderBy("c", "t").select("name").collect()
    assert [r[0] for r in got] == [None, "f", "own", ""]


def test_keep_first(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "i int, k string")
    marked = dedup.keep_first(df, F.col("k"), "i")
    assert {(r.i, r.is_first) for r in marked.collect()} == {(1, True), (2, False), (3, True)}
    assert tuple(dedup.duplicate_counts(marked).first()) == (3, 2, 1)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    from tessella.operators import dealing

    df = spark.range(400).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id % 40) WHEN id % 11 = 0 THEN null ELSE concat('one', id) END AS k", "'mine' AS fp").repartition(5)
    want = {}
    rows = {r.id: r.k for r in df.collect()}
    for i in sorted(rows):
        want.setdefault(rows[i], i)
    for bound in (1, 20, 1000):
        monkeypatch.setattr(dealing.left_join, "__defaults__", (bound,))
        got = dedup.keep_first(df, F.col("k"), "id").collect()
        assert len(got) == 400 and {r.id for r in got if r.is_first} == {i for i, k in rows.items() if k is None or want[k] == i}
        assert all(r.fp == r.k for r in got)
    monkeypatch.setattr(dealing, "KEYS", 0)
    monkeypatch.setattr(dealing.left_join, "__defaults__", (3,))
    assert dedup.keep_first(df, F.col("k"), "id").where("is_first").count() == sum(1 for i, k in rows.items() if k is None or want[k] == i)
    assert dedup.keep_first(df.limit(0), F.col("k"), "id").count() == 0


def test_contamination(spark):
    text = "please tell me the weather in the city of oslo today"
    train = spark.createDataFrame([(0, text), (1, text + "?"), (2, "completely unrelated zzz"), (3, None), (4, text)], "train_id int, train_text string")
    bench = spark.createDataFrame([("b", text), ("c", "ab"), ("d", ""), ("e", None)], "bench_id string, bench_text string")
    top = contamination.top_matches(train, bench).collect()
    got = [(r.rank, r.train_id, round(r.similarity, 4)) for r in sorted(top, key=lambda r: r.rank) if r.bench_id == "b"]
    assert got[:2] == [(0, 0, 1.0), (1, 4, 1.0)] and got[2][1] == 1 and 0.9 < got[2][2] < 1
    assert not [r for r in top if r.bench_id in "de"]
    in_blocks = contamination.top_matches(train, bench, block_bytes=1).collect()
    assert sorted(map(tuple, in_blocks)) == sorted(map(tuple, top))
    s = contamination.summary(contamination.top_matches(train, bench)).first()
    assert (s.n_near_cases, s.n_near_pairs) == (1, 3)
    assert [contamination.gate(*x) for x in ((1, 0), (0, 2), (0, 0))] == [2, 1, 0]
    hits = contamination.exact_matches(train.withColumnRenamed("train_text", "k"), bench.withColumnRenamed("bench_text", "k"), ["k"], most=1).collect()
    assert [tuple(r) for r in hits] == [("b", 2, [0])]


def test_sampling(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id < 3 THEN 'parallel_same' WHEN id < 40 THEN 'parallel_diff' ELSE 'ordinary' END kind")
    assert sorted(r.rk for r in sampling.numbered(df, 1, "id").collect()) == list(range(1, 101))
    parts = {r[0]: r[1] for r in sampling.split(df, 1, "id").groupBy("split").count().collect()}
    assert parts == {"train": 90, "eval": 10}
    full = sampling.filled(df.where("kind = 'parallel_same'"), 10, 1, "id").collect()
    assert len(full) == 10 and {r.id for r in full} == {0, 1, 2} and sum(r.draw == 0 for r in full) == 3
    mix = {r[0]: r[1] for r in sampling.targeted_mix(df, "kind", 40, 0.5, 0.25, 1, "id").groupBy("kind").count().collect()}
    assert mix == {"parallel_same": 5, "parallel_diff": 15, "ordinary": 20}
    assert sampling.half_even(2.5) == 2
    both = sampling.balanced_mix(df, "kind", {"parallel_same": 0.05}, 40, 1, "id").collect()
    assert len(both) == 40 and len({r.id for r in both}) == 40
    train = sampling.take(df, 90, 1, "id")
    out = sampling.evaluation_slice(df, train, "kind", {"ordinary": 20}, 1, "id")
    assert out.join(train, "id").count() == 0
    empty = df.where("id < 0")
    assert sampling.filled(empty, 5, 1, "id").count() == 0 and sampling.numbered(empty, 1, "id").count() == 0


def test_metrics(spark):
    none = spark.createDataFrame([], "category string, expected_tool boolean, tool_selection_correct boolean, arg_exact_match boolean, arg_key_accuracy double, valid_format boolean, canonical_format boolean, no_tool_correct boolean, clean_stop boolean, strict_protocol_success boolean, overall boolean, invalid_json boolean, wrong_tool boolean, missing_argument boolean, extra_argument boolean")
    got = metrics.aggregate(none).first().asDict()
    assert got["n_cases"] == 0 and got["overall_exact_match"] == 0.0
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("y", 3.0), ("z", 4.0)], "k string, v double")
    rows = {r.k: r for r in metrics.compare(a, b, "k", "v").collect()}
    assert rows["y"].delta == 1 and math.isnan(rows["x"].b) and math.isnan(rows["z"].a)
    assert "| Clean Stop Rate | 50.0% | n/a | n/a |" in metrics.markdown({"clean_stop_rate": 0.5}, "a", {}, "b")
    found, lost = metrics.joined_predictions(spark.createDataFrame([(1,), (9,)], "id int"), spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "id int, v string, o int"), order="o")
    assert found.first().v == "new" and lost.first().id == 9


def test_rewards(spark):
    df = spark.createDataFrame([(True, ["native", "bare"], ["f", "f"], ["f"], '<tool_call>x</tool_call>\n'), (False, [], [], [], "hello\nuser: x"), (True, ["native"], ["f", "g", "h"], ["f"], "no")], "tool boolean, sources array<string>, predicted array<string>, expected array<string>, text string")
    t = F.col("tool")
    got = df.select(rewards.canonical_format(t, F.col("sources"), F.lit(0)), rewards.clean_stop(t, F.col("text")), rewards.tool_selection(t, F.col("expected"), F.col("predicted")), rewards.parallel_completion(t, F.size("expected"), F.size("predicted"))).collect()
    assert [tuple(round(x, 6) for x in r) for r in got] == [(0.5, 1.0, 0.8, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 0.0, 0.6, 0.0)]


def test_masks(spark):
    df = spark.createDataFrame([(0, "abc"), (0, "a"), (0, "!"), (0, "abcdef")], "b int, text string")

    def toy(text):
        if text == "!":
            raise ValueError(text)
        return [ord(c) for c in text], [i % 2 for i in range(len(text))]

    got = masks.encoded(df, toy, "text", longest=4)
    assert [r.status for r in got.collect()] == ["ok", "ok", "invalid", "too_long"]
    out = masks.collated(got.where("status = 'ok'"), "b").collect()
    assert sorted(map(tuple, (r.labels for r in out))) == [(-100, -100, -100), (-100, 98, -100)]
    assert sorted(map(tuple, (r.attention_mask for r in out))) == [(1, 0, 0), (1, 1, 1)]
    assert masks.audit(got.where("status = 'ok'")).first().supervised_fraction == 0.25
    with pytest.raises(Exception, match="differ"):
        spark.createDataFrame([([1], [1, 0])], "i array<int>, k array<int>").select(masks.labels("i", "k")).collect()
    template = "{{- '<|im_start|>assistant\\n' }}{{ content }}{{- '<|im_end|>\\n' }}"
    marked = masks.marked_template(template)
    assert marked.count("generation %}") == 2 and masks.marked_template(marked) == marked
    with pytest.raises(ValueError):
        masks.marked_template("nothing")
    one = spark.createDataFrame([(template,), (marked,), (None,), ("a\n" + template + "b$1\\",)], "t string").select(masks.marked_templates(F.col("t")).alias("m"))
    assert [r.m for r in one.collect()] == [marked, marked, None, masks.marked_template("a\n" + template + "b$1\\")]
    for bad in ("nothing", "", template + template, template.split("{{- '<|im_end|>")[0], masks.TAIL + masks.HEAD):
        with pytest.raises(ValueError):
            masks.marked_template(bad)
        with pytest.raises(Exception, match="single assistant part"):
            spark.createDataFrame([(bad,)], "t string").select(masks.marked_templates(F.col("t"))).collect()


def test_generated_benchmark(spark):
    rows = generate(spark).collect()
    assert len(rows) == sum(PLAN.values()) == len({r.id for r in rows})
    for r in rows:
        names = {json.loads(t)["function"]["name"] for t in r.tools}
        assert {c.name for c in r.expect.calls} <= names
        assert (r.expect.mode == "tool") == bool(r.expect.calls)
        assert all(json.loads(c.arguments) for c in r.expect.calls)
    assert [tuple(r) for r in generate(spark).orderBy("id").collect()] == [tuple(r) for r in sorted(rows, key=lambda r: r.id)]


def test_macro_means_of_none(spark):
    from tessella.plans import registry

    assert "macro_means_of_none" not in registry.QUERIES  # an edge case, not a query
    none = spark.createDataFrame([], "category string, expected_tool boolean, tool_selection_correct boolean, arg_exact_match boolean, arg_key_accuracy double, valid_format boolean, canonical_format boolean, no_tool_correct boolean, clean_stop boolean, strict_protocol_success boolean, overall boolean, invalid_json boolean, wrong_tool boolean, missing_argument boolean, extra_argument boolean")
    got = metrics.aggregate(none).first()
    assert (got.n_cases, got.tool_selection_accuracy, got.overall_exact_match) == (0, 0.0, 0.0)


def test_keep_first_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "a", "u"), (2, "a", "v"), (3, None, "w"), (4, None, "w"), (None, "b", "x")], "i int, fp string, is_first string")
    got = dedup.keep_first(df, F.col("fp"), "i")
    assert sorted((r.i or 0, r.fp or "", r.is_first) for r in got.collect()) == [(0, "b", True), (1, "a", True), (2, "a", False), (3, "", True), (4, "", True)]
    assert tuple(dedup.duplicate_counts(got).first()) == (5, 4, 1)
    assert dedup.keep_first(df.limit(0), F.col("fp"), "i").count() == 0
    bad = spark.createDataFrame([(1, "{bad"), (2, "{bad"), (3, "[1]"), (4, "[ 1 ]")], "i int, t string")
    from tessella.functions.canonical import fingerprint

    kept = dedup.keep_first(bad, fingerprint(F.col("t"), F.lit(None).cast("string")), "i").where("is_first").collect()
    assert sorted(r.i for r in kept) == [1, 2, 3]


def test_gram_scores_are_brute_force(spark):
    import math
    import random
    import re
    from collections import Counter

    from tessella.operators import contamination

    def counts(t, n=4):
        t = re.sub(r"\s+", "", t or "").lower()
        return Counter(t[i : i + n] for i in range(len(t) - n + 1)) if len(t) > n else Counter([t] if t else [])

    def cosine(a, b):
        a, b = counts(a), counts(b)
        dot = sum(a[g] * b[g] for g in a.keys() & b.keys())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else 0.0

    r = random.Random(3)
    text = lambda: "".join(r.choice("ab Ab\né🙂") for _ in range(r.choice([0, 1, 3, 4, 5, 30, 200])))
    train = [(k, text()) for k in range(60)] + [(60, None), (61, "ab"), (62, "ab"), (63, "abab" * 5000)]
    bench = [(k, text()) for k in range(15)] + [(15, None), (16, "ab"), (17, "ABAB" * 300)]
    every = {(b, k): cosine(x, t) for b, t in bench for k, x in train if cosine(x, t) > 0}
    texts = [t for _, t in train]
    both = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", contamination.char_gram_counts("t").alias("g"), T.char_gram_counts(F.col("t")).alias("h")).collect()
    assert all((x.g.n_grams, x.g.n_distinct) == (sum(counts(texts[x.i]).values()), len(counts(texts[x.i]))) == (x.h.n_grams, x.h.n_distinct) for x in both)
    limits = ("_ROWS", "_CHARS", "_PAIRS", "_TILE", "_TRAFFIC", "_LEFT")
    old = [getattr(contamination, x) for x in limits]
    for now in ((4096, 1 << 20, 1 << 22, 1 << 21, 4, 0.5), (7, 100, 50, 40, 4, 0.5), (7, 100, 50, 40, 0, 1.0), (64, 5000, 1 << 20, 400, 0, 1.0)):
        rows = now[0]
        for x, v in zip(limits, now, strict=True):
            setattr(contamination, x, v)
        for top_k in (1, 2, 5, len(train)):
            best = contamination.Best(contamination.Index(bench, 4), top_k)
            for at in range(0, len(train), 9):
                best.take([t for _, t in train[at : at + 9]], [k for k, _ in train[at : at + 9]])
            got = {(b, t): float(s) for b, t, s in zip(*best.rows(), strict=True)}
            want = {}
            for b, _ in bench:
                own = sorted(((-round(v, 12), k) for (x, k), v in every.items() if x == b))[:top_k]
                want |= {(b, k): -v for v, k in own}
            assert got == pytest.approx(want, rel=1e-9), (rows, top_k)
    for x, v in zip(limits, old, strict=True):
        setattr(contamination, x, v)
    df = lambda rows, side: spark.createDataFrame(rows, f"{side}_id int, {side}_text string")
    got = {(x.bench_id, x["rank"]): x.train_id for x in contamination.top_matches(df(train, "train"), df(bench, "bench"), top_k=3).collect()}
    want = {}
    for b, t in bench:
        best = sorted(((-round(cosine(x, t), 12), k) for k, x in train if cosine(x, t) > 0))[:3]
        want |= {(b, n): k for n, (_, k) in enumerate(best)}
    assert got == want
    small = {(x.bench_id, x["rank"]): x.train_id for x in contamination.top_matches(df(train, "train"), df(bench, "bench"), top_k=3, block_bytes=700).collect()}
    assert small == want
    assert contamination.top_matches(df(train, "train"), df([], "bench")).count() == 0 == contamination.top_matches(df([], "train"), df(bench, "bench")).count()


def test_shared_folder_needs_a_setting_on_a_cluster():
    from tessella.session import shared_dir

    class Fake:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake)


def test_entry_survives_missing_parts(tmp_path):
    """Without what the corpus operators import, all other queries are there."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'), len(e.queries()) > 100, 'score_variants' in e.oracle_sql())"
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": root})
    assert got.stdout.strip() == "[] True True", got.stderr


def test_generated_cases(spark):
    from tessella.operators import benchgen

    cases = benchgen.generate(spark, 3)
    assert tuple(benchgen.invariants(cases, list(benchgen.PLAN)).first()) == (280, True, [], 0)
    assert {r.category: r.n for r in benchgen.category_counts(cases).collect()} == benchgen.PLAN
    assert benchgen.generate(spark, 3).exceptAll(cases).count() == 0 < benchgen.generate(spark, 4).exceptAll(cases).count()
    empty = benchgen.invariants(cases.limit(0), ["x"]).first()
    assert (empty.n, empty.missing) == (0, ["x"])
    import json

    for r in cases.collect():
        tools = [json.loads(t)["function"] for t in r.tools]
        assert len({t["name"] for t in tools}) == len(tools)
        for c in r.expect.calls:
            own = next(t for t in tools if t["name"] == c.name)
            given = json.loads(c.arguments)
            assert set(own["parameters"]["required"]) <= given.keys() <= own["parameters"]["properties"].keys()
            assert all(v in " ".join(m.content for m in r.messages) for v in given.values())


def test_common_grams_are_multiplied_exactly(monkeypatch):
    """Matrices in single and double precision, lookups alone, and a floor: the same best rows; and texts of one vocabulary take no lookup for each pair of grams."""
    import random
    import time

    from tessella.operators import contamination as C

    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcde") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 40, 400]))) for _ in range(260)] + [None, "", "a", "a" * 3000]
    index = C.Index([(k, t) for k, t in enumerate(texts[:60] + texts[-4:])], 4)

    def rows(floor=0.0):
        best = C.Best(index, 5, floor)
        best.take(texts, list(range(len(texts))))
        return list(zip(*(x if isinstance(x, list) else x.tolist() for x in best.rows()), strict=True))

    want = rows()
    assert [x for x in want if x[2] >= 0.7] == rows(0.7) and len(rows(0.7)) < len(want)
    for name, value in (("_EXACT", 1 << 8), ("_CELLS", 0), ("_CELLS", 64 * 100), ("_COMMON", 1)):
        with monkeypatch.context() as m:
            m.setattr(C, name, value)
            assert rows() == want and rows(0.7) == [x for x in want if x[2] >= 0.7]
    many = [" ".join(r.choice(vocabulary) for _ in range(500)) for _ in range(1000)]
    best, began = C.Best(C.Index(list(enumerate(many[:400])), 4), 5), time.process_time()
    best.take(many, list(range(len(many))))
    assert time.process_time() - began < 8  # 19 s by lookups

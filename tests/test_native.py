import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import assignment, flatten, scoring
from tessella.functions.canonical import canonical, canonical_json
from tessella.operators import metrics, picking, sampling


def values(r, depth=0):
    kind = r.randrange(9 if depth < 4 else 7)
    if kind == 7:
        return [values(r, depth + 1) for _ in range(r.randrange(4))]
    if kind == 8:
        return {r.choice(["a", "b", " c", "0", ".a", "é", "x.y", ""]): values(r, depth + 1) for _ in range(r.randrange(4))}
    return [None, True, False, r.randint(-3, 3), r.choice([0.5, 1.0, 1e3, 2.25]), r.choice(["a", " a  b\n", "é", "é", "", "1"]), r.choice([10**15, 10**20, -(10**25)])][kind]


def test_fingerprints_are_equal_where_canonical_json_is(spark):
    r = random.Random(1)
    seen = [values(r) for _ in range(250)]
    rows = []
    for k, v in enumerate(seen):
        rows += [(2 * k, json.dumps(v)), (2 * k + 1, json.dumps(v, indent=1, ensure_ascii=False, sort_keys=True))]
    rows += [(1000, None), (1001, "{bad"), (1002, ""), (1003, '{"a": 1, "a": 2}'), (1004, " [ ] ")]
    df = spark.createDataFrame(rows, "i int, j string")
    got = {x.id: x.fp for x in flatten.json_fingerprints(df, "i", "j").collect()}
    assert len(got) == len(rows) and [got[k] for k in range(1000, 1004)] == [None] * 4
    plain = {2 * k + s: canonical_json(v) for k, v in enumerate(seen) for s in (0, 1)} | {1004: "[]"}
    by_plain, by_rows = {}, {}
    for k, text in plain.items():
        by_plain.setdefault(text, set()).add(k)
        by_rows.setdefault(got[k], set()).add(k)
    assert sorted(map(sorted, by_plain.values())) == sorted(map(sorted, by_rows.values())) and len(by_plain) > 60
    assert flatten.json_fingerprints(df.limit(0), "i", "j").count() == 0 == flatten.json_rows(df.limit(0), "i", "j").count()


def test_canonical_text_in_the_jvm(spark):
    r = random.Random(2)
    signs = "ab \t\n\x0b\x1c\x85  　éé가Å​🙂̈́ﬁ"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(12))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.c for x in df.select("i", flatten.canonical_text("t").alias("c")).collect()}
    assert all(got[k] == (None if t is None else canonical(t)) for k, t in enumerate(texts))


VALUES = ['"Oslo. "', '"oslo"', '"3"', "3", '"3.0!"', '"1_000"', "1000", '"3d"', "true", "1", "false", "0", '"inf"', '"Infinity"', '"-inf"', '"nan"', "null", '"北京。"', '"北京"', '"a b"', '"a  b"', "1.50", "1.5", "1e3", '".5"', '"5."', '"_1"', '"1__0"', '" x。 "', '"X"', '""', '"."']


def test_comparable_is_the_python_form(spark):
    got = {x.v: x.c for x in spark.createDataFrame([(v,) for v in VALUES], "v string").select("v", assignment.comparable("v").alias("c")).collect()}
    for a in VALUES:
        for b in VALUES:
            same = scoring.comparable(json.loads(a)) == scoring.comparable(json.loads(b))
            mine = got[a] == got[b] and got[a] != "x"
            assert mine == same, (a, b)


def test_assignment_is_the_python_form(spark):
    r = random.Random(3)
    pool = ["3", '"3"', "4", "null", '"nan"', '"a."', '"A"', "true"]
    calls = lambda n: [{"name": r.choice("fg"), "arguments": {k: r.choice(pool) for k in r.sample("xyz", r.randrange(4))}} for _ in range(n)]
    rows = [(k, calls(r.randrange(5)), calls(r.randrange(6))) for k in range(300)] + [(300, [], []), (301, None, None)]
    kind = "array<struct<name: string, arguments: map<string, string>>>"
    df = spark.createDataFrame(rows, f"i int, e {kind}, p {kind}")
    for c in "ep":
        df = df.withColumn(c, F.transform(c, lambda x: assignment.call(x["name"], F.transform_values(x["arguments"], lambda _, v: v))))
        df = df.selectExpr("*", f"transform({c}, x -> named_struct('name', x.name, 'keys', map_keys(x.arguments), 'values', map_values(x.arguments))) AS raw_{c}").drop(c)
        flat = df.select("*", F.posexplode_outer(f"raw_{c}").alias("n", "x")).select("*", F.posexplode_outer("x.values").alias("m", "v")).withColumn("v", assignment.comparable("v"))
        flat = flat.groupBy("i", "n").agg(F.first("x").alias("x"), F.array_sort(F.collect_list(F.struct("m", "v"))).alias("vs")).where("n IS NOT NULL")
        one = F.struct(F.col("n"), F.col("x.name").alias("name"), F.map_from_arrays("x.keys", F.when(F.size("x.keys") > 0, F.col("vs.v")).otherwise(F.array().cast("array<string>"))).alias("arguments"))
        flat = flat.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("n", F.struct(F.col("x.name").alias("name")).alias("o")))).alias("unused"), F.collect_list(one).alias(c)).drop("unused")
        df = df.join(flat, "i", "left").withColumn(c, F.expr(f"transform(array_sort(coalesce({c}, cast(array() as array<struct<n: int, name: string, arguments: map<string, string>>>)), (a, b) -> a.n - b.n), x -> named_struct('name', x.name, 'arguments', x.arguments))")).drop(f"raw_{c}")
    got = {x.i: x.a for x in df.select("i", assignment.assigned(F.col("e"), F.col("p")).alias("a")).collect()}
    loads = lambda xs: [{"name": x["name"], "arguments": {k: json.loads(v) for k, v in x["arguments"].items()}} for x in xs or []]
    for i, e, p in rows:
        assert got[i] == scoring.assign(loads(e), loads(p)), i


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_picks_of_any_size(spark, few):
    df = spark.range(500).selectExpr("id", "id % 7 AS g").repartition(5)
    order = sorted((r.p, r.id) for r in df.select("id", sampling.place(3, "id").alias("p")).collect())
    for k in (-1, 0, 1, 10, 499, 500, 900):
        assert sorted(r.id for r in picking.first(df, k, sampling.place(3, "id"), ["id"], few).collect()) == sorted(i for _, i in order[: max(0, k)])
    for k in (3, 100, 333):
        got = picking.first(df, k, picking.digits(F.col("g")), ["id"], few)
        assert got.columns == ["id", "g"]
        assert sorted((r.g, r.id) for r in got.collect()) == sorted((i % 7, i) for i in range(500))[:k]
    same = spark.range(300).selectExpr("5 AS id", "id AS x").repartition(4)
    for k in (1, 20, 150, 300, 400):
        assert len({r.x for r in picking.first(same, k, sampling.place(3, "id"), ["id"], few).collect()}) == min(k, 300)
    assert picking.first(df.limit(0), 20, sampling.place(3, "id"), ["id"], few).count() == 0


def test_numbers_as_digits_keep_their_order(spark):
    numbers = [0, 1, -1, 255, -256, 2**63 - 1, -(2**63), 10**12, -(10**12)]
    got = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "n long").select("n", picking.digits(F.col("n")).alias("d")).collect()
    assert [r.n for r in sorted((r for r in got if r.n is not None), key=lambda r: r.d)] == sorted(numbers)
    rows = spark.createDataFrame([(n,) for n in numbers] + [(None,)] * 3, "n long")
    for few in (1, 100):
        assert sorted(r.n for r in picking.first(rows, 4, picking.digits(F.col("n")), None, few).collect()) == sorted(numbers)[:4]
        assert sum(r.n is None for r in picking.first(rows, 11, picking.digits(F.col("n")), None, few).collect()) == 2


SCORE = "category string, expected_tool boolean, " + ", ".join(f"{c} {'double' if c == 'arg_key_accuracy' else 'boolean'}" for c in dict.fromkeys(metrics.FLAGS.values()))


def test_grouping_sets_are_the_separate_aggregates(spark):
    r = random.Random(5)
    flag = lambda: r.choice([True, False, None])
    columns = list(dict.fromkeys(metrics.FLAGS.values()))
    rows = [(r.choice(["a", "b", None, "parallel_x"]), flag(), *(r.choice([0.0, 0.5, 1.0, None]) if c == "arg_key_accuracy" else flag() for c in columns)) for _ in range(200)]
    for part in (rows, [x for x in rows if x[1]], [x for x in rows if not x[1]], []):
        df = spark.createDataFrame(part, SCORE).withColumn("level", F.lit("mine")).withColumn("n", F.lit(1))
        sets = metrics.by_sets(df)
        want, got = metrics.aggregate(df).first().asDict(), metrics.overall(sets).first().asDict()
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
        each = {x.category: x for x in metrics.by_category(df).collect()}
        mine = {x.category: x for x in sets.where("level = 'category'").collect()}
        assert each.keys() == mine.keys()
        assert all((x.n, x.overall, x.strict) == (mine[k].n, mine[k].n_overall, mine[k].n_strict) and math.isclose(x.accuracy, mine[k].overall_exact_match) for k, x in each.items())
        assert {x.level for x in sets.collect()} <= {"all", "tool", "no_tool", "category"}


def test_fingerprints_open_deep_and_wide_texts_in_their_row(spark):
    deep, wide = '{"a": [' * 150 + "1" + "]}" * 150, json.dumps({f"k{i}": [i, "[{"] for i in range(3000)})
    df = spark.createDataFrame([(1, deep), (2, wide), (3, deep.replace("1", "2")), (4, " " + wide), (None, "1")], "i int, j string")
    fingerprints = flatten.json_fingerprints(df, "i", "j")
    assert "Exchange" not in fingerprints._jdf.queryExecution().executedPlan().toString()
    got = {x.id: x.fp for x in fingerprints.collect()}
    assert got[2] == got[4] != got[1] != got[3] and got[1] and got[3] and got[None] is None and len(got) == 5
    counts = {x.id: (x.n, x.m) for x in flatten.json_rows(df, "i", "j").groupBy("id").agg(F.count("*").alias("n"), F.max(F.size("path")).alias("m")).collect()}
    assert counts[1] == (301, 300) and counts[2] == (9001, 2)
    # Rows of one id are taken for one.
    again = flatten.json_fingerprints(df.unionByName(df.where("i = 1").withColumn("j", F.lit("{bad"))), "i", "j").collect()
    assert len(again) == 5 and {x.id: x.fp for x in again} == got

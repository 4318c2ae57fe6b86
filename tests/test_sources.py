import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import callbench, config, converters, files
from tessella.streaming import dedup


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "é"}\n\n  \n{"a": 2}\n', encoding="utf-8")
    df = files.read_jsonl(spark, str(p), "a int, b string")
    assert sorted(map(tuple, df.collect())) == [(1, "é"), (2, None)]
    out = str(tmp_path / "out")
    files.write_jsonl(df.orderBy("a"), out, one_file=True)
    assert [json.loads(x.value) for x in spark.read.text(out).collect()] == [{"a": 1, "b": "é"}, {"a": 2, "b": None}]
    assert files.read_jsonl_text(spark, str(p)).count() == 2
    p.write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        files.read_jsonl_text(spark, str(p)).collect()
    p.write_text("{bad\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "a int").collect()
    assert files.capped(spark.range(9), 4, "id").count() == 4 and files.capped(spark.range(9), None).count() == 9


def test_mirror(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/train.jsonl").write_text('{"a": 1}\n')
    (tmp_path / "x/eval.jsonl").write_text('{"a": 2, "b": 3}\n')
    (tmp_path / "c.csv").write_text("a\n1\n")
    assert files.read_mirror(spark, str(tmp_path), "test").first().a == 2
    both = files.read_mirror(spark, str(tmp_path), union=True)
    assert sorted(map(tuple, both.select("a", "b").collect()), key=str) == [(1, None), (2, 3)]
    with pytest.raises(FileNotFoundError):
        files.most_common_format(["a.txt"])
    tries = []

    def remote():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return spark.range(1)

    def missing():
        raise FileNotFoundError

    assert files.loaded(missing, remote, wait=0).count() == 1 and len(tries) == 3


def test_paths_and_settings(tmp_path):
    assert files.inside(tmp_path, "a/b") == (tmp_path / "a/b").resolve()
    with pytest.raises(ValueError):
        files.inside(tmp_path, "../x")
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/a.yaml").write_text('{"x": {"y": 1}}')
    got = config.load("a", tmp_path)
    assert config.merged(got, {"x": {"z": 2}}) == {"x": {"y": 1, "z": 2}} and got == {"x": {"y": 1}}
    assert config.overrides(["a=1", "b=x", "c=true", "d=[1, 2]"]) == {"a": 1, "b": "x", "c": True, "d": [1, 2]}
    with pytest.raises(KeyError):
        config.require({}, ["a"])
    files.write_document({"é": 1}, tmp_path / "d/r.json")
    assert json.loads((tmp_path / "d/r.json").read_text()) == {"é": 1}


def _one(name, row):
    return converters.CONVERTERS[name][0](row)


def test_converters():
    tools = json.dumps([{"name": "f", "parameters": {}}])
    messages, got = _one("share_gpt_en", {"conversations": json.dumps([{"from": "human", "value": "q"}, {"from": "function_call", "value": '{"name":"f","arguments":"{}"}'}, {"from": "observation", "value": {"a": 1}}, {"from": "gpt", "value": "r"}]), "tools": tools})
    assert [x["role"] for x in messages] == ["system", "user", "assistant", "tool", "assistant"]
    assert messages[3]["name"] == "f" and messages[3]["content"] == '{"a": 1}' and got[0]["function"]["name"] == "f"
    messages, _ = _one("tagged_calls", {"conversations": json.dumps([{"from": "system", "value": "s"}, {"from": "human", "value": "q"}, {"from": "gpt", "value": 'so <tool_call>{"name":"f","arguments":{}}</tool_call>'}, {"from": "tool", "value": "x"}]), "tools": "[]"})
    assert [x["role"] for x in messages] == ["system", "user", "assistant"] and messages[2]["content"] == "so" and messages[0]["content"] == "s"
    messages, got = _one("typed_with_tools", {"tools": tools, "conversations": json.dumps([{"role": "user", "content": "q"}, {"role": "assistant", "tool_calls": [{"function": {"name": "f", "arguments": "bad"}}]}, {"role": "tool", "content": [1]}])})
    assert messages[2]["tool_calls"][0]["arguments"] == {"raw": "bad"} and messages[3]["name"] == "f" and messages[3]["content"] == "[1]"
    assert _one("typed_with_tools", {"tools": tools, "conversations": "{bad"}) is None
    messages, got = _one("typed_messages", {"messages": json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}])})
    assert len(messages) == 3 and got == []
    assert _one("reasoning", {"problem": "p", "thinking": "t", "solution": "s"})[0][1]["content"].startswith("<think>\nt\n")
    assert _one("reasoning", {"problem": "", "solution": "s"}) is None
    messages, got = _one("prompt_response", {"systemPrompt": '[{"name":"f","x":1}]', "userPrompt": "q", "assistantResponse": '{"function":"f","arguments":[{"a":1}]}'})
    assert messages[2]["tool_calls"] == [{"name": "f", "arguments": {"a": 1}}] and len(got) == 1


def test_convert_frames(spark):
    df = spark.createDataFrame([(1, "p", None, "s", "clash"), (2, None, None, "s", "x"), (3, "p", "t", "", "x")], "n long, problem string, thinking string, solution string, messages string")
    got = converters.convert(df, "reasoning", "n").collect()
    assert [(r.sample_id, r.source, len(r.messages), r.tools) for r in got] == [(1, "reasoning", 2, None)]
    typed = spark.createDataFrame([(1, [("human", "q"), ("gpt", "r")], "[]")], "n long, conversations array<struct<`from`: string, value: string>>, tools string")

    def broken():
        raise OSError("gone")

    def late():
        return spark.range(1000).select(F.col("id").alias("n"), F.expr("if(id = 999, raise_error('late'), '[]')").cast("string").alias("conversations"), F.lit("[]").alias("tools"))

    out, failed = converters.convert_all({"share_gpt_zh": lambda: typed, "reasoning": broken, "tagged_calls": late}, id_col="n")
    assert out.count() == 1 and failed.keys() == {"reasoning", "tagged_calls"} and failed["reasoning"] == "gone"
    assert converters.convert_all({"share_gpt_zh": lambda: typed}, only=["x"], id_col="n") == (None, {})
    assert converters.convert(df.limit(0), "reasoning", "n").count() == 0
    assert [r.sample_id for r in converters.convert(df.unionByName(df.selectExpr("n + 4 AS n", "problem", "thinking", "solution", "messages")), "reasoning", "n", cap=5).collect()] == [1, 5]


def test_numbered_lines_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 90) for k in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("only\n")
    (tmp_path / "c.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {(r.file.rsplit("/", 1)[1], r.line_no): r.value for r in files.numbered_lines(spark, str(tmp_path)).collect()}
            assert got == {("a.txt", k): x for k, x in enumerate(lines)} | {("b.txt", 0): "only"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_named_files_and_documents(spark, tmp_path):
    path = f"file://{tmp_path}/x/rows.jsonl"
    for n in (3, 2):  # the second overwrites
        files.write_jsonl_file(spark.range(n), path)
        assert (tmp_path / "x/rows.jsonl").read_text().count("\n") == n
    assert sorted(x.name for x in (tmp_path / "x").iterdir() if not x.name.endswith(".crc")) == ["rows.jsonl"]
    files.write_document({"é": [1]}, f"file://{tmp_path}/y/r.json", spark)
    assert json.loads((tmp_path / "y/r.json").read_text()) == {"é": [1]}


def test_call_benchmark(spark):
    q = spark.createDataFrame([("a", '[[{"role":"user","content":"q"}]]', '[{"name":"f","parameters":{"properties":{"x":{"type":"float"}}}}]'), ("b", "[[]]", "[]")], "id string, question string, function string")
    a = spark.createDataFrame([("a", '[{"f":{"x":["",2],"y":["",null]}}]')], "id string, ground_truth string")
    got = callbench.cases(q, a, "parallel", 5).collect()
    assert len(got) == 1 and json.loads(got[0].expect.calls[0].arguments) == {"x": 2} and got[0].messages[0].content == "q"
    assert json.loads(got[0].tools[0])["function"]["parameters"]["properties"]["x"]["type"] == "number"
    assert {r.expect.mode for r in callbench.cases(q, None, "", 5).collect()} == {"no_tool"}
    assert tuple(callbench.chosen(q, a, 5)[1].first()) == (1, 1) and tuple(callbench.chosen(q, a.limit(0), 5)[1].first()) == (0, 2)
    assert tuple(callbench.chosen(q, a, 0)[1].first())[0] == 0


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 00:02:00")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "i int, k string, t string").select("i", "k", F.col("t").cast("timestamp").alias("t")).write.parquet(src)
    stream = spark.readStream.schema("i int, k string, t timestamp").parquet(src)
    q = dedup.first_seen(stream, F.md5("k"), "t").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2
    q = dedup.counts(stream, "t", "k").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.n for r in spark.table("counts").collect()} == {"a": 2, "b": 1}


def test_paths_of_stores_stay_inside():
    for root in ("file:///a/b", "/a/b", "s3://bucket/a"):
        scheme = root.partition("://")[0] + "://" if "://" in root else ""
        base = root.removeprefix(scheme)
        assert files.inside_store(root, "x/./y//z") == f"{root}/x/y/z" == files.inside_store(root, f"{root}/x/q/../y/z")
        assert files.inside_store(root, ".") == root and files.inside_store(root, f"{base}/x" if base.startswith("/") else "x") == f"{root}/x"
        for bad in ("..", "../b2", "x/../../c", f"{root}2/x", "/elsewhere", "hdfs://other/x"):
            with pytest.raises(ValueError):
                files.inside_store(root, bad)


def test_paths_in_columns(spark):
    import itertools
    import posixpath

    steps = ["a", "b", "..", ".", ""]
    paths = ["/".join(p) for n in range(1, 5) for p in itertools.product(steps, repeat=n)]
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in paths] + [("s3://x",), ("/a",)], "p string").select("p", files.inside_column(F.col("p")).alias("x")).collect()}

    def want(p):
        depth = 0
        for step in p.split("/"):
            depth += {"..": -1, ".": 0, "": 0}.get(step, 1)
            if depth < 0:
                return None
        return None if p.startswith("/") else posixpath.normpath(p) if p and posixpath.normpath(p) != "." else ""

    assert all(got[p] == want(p) for p in paths) and got["s3://x"] is None and got["/a"] is None
    assert spark.sql("SELECT CAST(NULL AS string) AS p").select(files.inside_column(F.col("p"))).first()[0] is None


def test_settings_of_any_store(spark, tmp_path):
    root = f"file://{tmp_path}"
    for place, text in (("one.yaml", "a: 1"), ("configs/two.yaml", "a: {b: [2, é]}"), ("configs/three.yaml", '{"a": 3}'), ("configs/list.yaml", "- 1")):
        files.write_text(spark, text, f"{root}/{place}")
    assert config.load(f"{root}/one.yaml", root, spark) == config.load("one.yaml", root, spark) == {"a": 1}
    assert config.load("two.yaml", root, spark) == config.load("two", root, spark) == config.load("two", tmp_path) == {"a": {"b": [2, "é"]}}
    assert config.load("three", root, spark) == {"a": 3}
    for bad, error in (("four", FileNotFoundError), ("configs", FileNotFoundError), ("list", ValueError)):
        with pytest.raises(error):
            config.load(bad, root, spark)
    assert files.read_file(spark, f"{root}/none") is None and files.read_file(spark, root) is None


def test_files_of_one_name_are_as_many_as_the_partitions(spark, tmp_path):
    root = str(tmp_path / "m")
    for rest, name in ((0, "eval.jsonl"), (1, "train.jsonl")):
        files.write_jsonl_files(spark.range(100).repartition(3).where(f"id % 2 = {rest}"), f"{root}/{rest}", name)
    found = files.listed(spark, root)
    assert sum(x.endswith("/eval.jsonl") for x in found) == sum(x.endswith("/train.jsonl") for x in found) == 3
    assert not any("part-" in x for x in found)
    assert sorted(r.id for r in files.read_mirror(spark, root, "test").collect()) == list(range(0, 100, 2))

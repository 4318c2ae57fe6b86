import json
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import openjson, tools
from tessella.functions.canonical import canonical_json, canonical_json_of
from tessella.functions.openjson import DEPTH, deep_from, leading, loads
from tessella.functions.scoring import score_case
from tessella.functions.toolcalls import parse, parse_tool_calls, register_calls
from tessella.sources import converters


def nested(n, middle="1"):
    return "[" * n + middle + "]" * n


def test_depth_is_bounded():
    assert loads(nested(DEPTH)) and canonical_json(loads(nested(DEPTH))) == nested(DEPTH)
    for text in (nested(DEPTH + 1), nested(100_000), '{"a":' * 5000 + "1" + "}" * 5000, "[" * 20_000):
        with pytest.raises(ValueError):
            loads(text)
    flat = json.dumps(["[{" * 500, {"a}]": '\\"[['}] * 50)
    assert loads(flat) == json.loads(flat) and deep_from(flat) is None
    assert deep_from('"' + "[" * 1000) is None  # all of it is in a string, though that never ends
    assert deep_from("[1] " + nested(DEPTH + 5)) == 4
    assert deep_from("]" * 500 + "[" * 10 + "}" * 500) is None


def test_depth_is_found_in_linear_time():
    began = time.time()
    for text in ('"\\"' * 200_000 + "[" * 300, '"' + "\\" * 300_001 + "[" * 300, '[{"' * 200_000, "[" * 600_000):
        deep_from(text)
    assert time.time() - began < 5


def test_halves_of_pairs_become_a_sign():
    assert loads('{"\\ud83d": ["\\ude00x", "\\ud83d\\ude00"]}') == {"�": ["�x", "😀"]}
    canonical_json(loads('"\\udfff"')).encode()


def test_leading_values():
    assert list(leading(' {"a": 1} [2]\n3 [4]')) == [{"a": 1}, [2]]
    assert list(leading("{} " + nested(300) + " {}")) == [{}]
    assert list(leading("x {}")) == list(leading("")) == list(leading("{")) == []


def test_no_generation_ends_the_job():
    call = '{"name": "a", "arguments": {"x": 1}}'
    for tail in ("[" * 20_000, '{"a":' * 20_000, nested(3000), "\\ud800", '{"x": "\\ud800"}', "9" * 10_000, "]" * 9999, "```" * 999):
        got = parse(f"<tool_call>{call}</tool_call><tool_call>{tail}")
        assert [c["name"] for c in got["calls"]][:1] == ["a"] and got["invalid_blocks"] == [tail]
        assert [c["name"] for c in parse(f"{call} {tail}")["calls"]] == ["a"]
        json.dumps(parse(f"```{call}```{tail}"), ensure_ascii=False).encode()
    assert parse('{"name": "a", "arguments": "' + "[" * 9000 + '"}')["calls"] == [{"name": "a", "arguments": {}, "valid_json": False, "raw": json.dumps({"name": "a", "arguments": "[" * 9000}), "source": "bare"}]
    began = time.time()
    parse("<tool_call>" + " " * 400_000 + "x")
    parse("<tool_call>x</tool_call>" * 20_000)
    assert time.time() - began < 5


def test_open_and_empty_blocks():
    assert [c["name"] for c in parse('<tool_call> \n</tool_call><tool_call>{"name": "a"}<tool_call>{"name": "b"}</tool_call>x<tool_call>{"name": "c"}')["calls"]] == ["a", "c"]
    assert parse("<tool_call>")["invalid_blocks"] == []
    assert parse("</tool_call><tool_call>x")["invalid_blocks"] == ["x"]


def test_odd_shapes_of_tools():
    assert tools.schema_property({"type": []}) == {}
    assert tools.schema_property({"type": ["null", None]}) == {"type": "null"}
    assert tools.schema_property({"type": ["null", "float", "dict"]}) == {"type": "number"}
    assert tools.wrap_tool({"type": "function", "function": 3}) == {"type": "function", "function": 3}


def test_columns(spark):
    deep = nested(5000)
    rows = [(1, '<tool_call>{"name": "a", "arguments": {"q": "\\ud83d"}}</tool_call>'), (2, None), (3, ""), (4, deep), (5, "<tool_call>" + deep), (6, "text"), (7, '\n\t {"name": "b"} {"name": "c"} x'), (8, "say <|im_end|>")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.p for r in df.select("id", parse_tool_calls("text").alias("p")).collect()}
    assert {k: [c.name for c in p.calls] for k, p in got.items()} == {1: ["a"], 2: [], 3: [], 4: [], 5: [], 6: [], 7: ["b", "c"], 8: []}
    assert {k for k, p in got.items() if p.invalid_blocks} == {5}
    register_calls(spark)
    df.createOrReplaceTempView("generations")
    calls = spark.sql("SELECT g.id, c.* FROM generations g, LATERAL tool_calls(g.text) c").collect()
    assert sorted((r.id, r.call_no, r.name, r.arguments, r.source, r.valid_json) for r in calls) == [(1, 0, "a", '{"q": "�"}', "native", True), (7, 0, "b", "{}", "bare", True), (7, 1, "c", "{}", "bare", True)]
    assert df.select(canonical_json_of("text").alias("c")).where("c IS NOT NULL").count() == 0
    shapes = spark.createDataFrame([('{"name": "f", "parameters": {"properties": {"x": {"type": []}}}}',), (deep,), ("[]",), (None,), ('{"name": "f", "parameters": {"properties": {"x": {"type": {}}}}}',)], "t string")
    assert [r.t is None for r in shapes.select(tools.schema_tools("t").alias("t")).collect()] == [False, True, True, True, True]
    want = F.array(F.struct(F.lit("a").alias("name"), F.lit(deep).alias("arguments")), F.struct(F.lit("a").alias("name"), F.lit("[1]").alias("arguments")))
    scored = df.select("id", score_case(F.lit("tool"), want, "text", F.lit(None).cast("boolean")).alias("s")).collect()
    assert len(scored) == len(rows) and all(r.s.overall is False for r in scored)


def test_converters_skip_what_they_cannot_read(spark):
    rows = [(0, nested(5000), None), (1, '[{"from": "human", "value": "q"}, {"from": "gpt", "value": "\\ud83d"}]', nested(9000)), (2, '[{"from": "human", "value": "q"}, {"from": "function_call", "value": "' + "[" * 900 + '"}]', "[]")]
    df = spark.createDataFrame(rows, "line_no long, conversations string, tools string")
    got = converters.convert(df, "share_gpt_en").collect()
    assert sorted(r.sample_id for r in got) == [1, 2]
    assert next(r for r in got if r.sample_id == 1).messages[1].content == "?"
    assert openjson.DEPTH == 200

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.canonical import canonical_json, canonical_json_of, fingerprint
from tessella.functions.scoring import assign, comparable, score
from tessella.functions.toolcalls import parse, parse_tool_calls
from tessella.functions.tools import accepted_value, make_call, schema_function, wrap_tool


def test_canonical_json_spaces_nfc_and_order():
    assert canonical_json({"b": "é  　x ", "a": [1, 1.0, None]}) == '{"a":[1,1.0,null],"b":"é x"}'


def test_fingerprint_null_tools_are_none_and_order_matters(spark):
    rows = [('[{"role":"user","content":"a  b"}]', None), ('[{"content":"a b","role":"user"}]', "[]"), ('[{"role":"user","content":"a b"}]', '[{"x":1}]'), ("not json", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, t string").select(fingerprint(F.col("m"), F.col("t"))).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None


def test_whitespace_and_grams(spark):
    rows = [("a 　 B\n",), ("",), (None,), ("ab",), ("aé bcde",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(T.normalize(F.col("t")), T.char_grams(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a b", "", None, "ab", "aé bcde"]
    assert [r[1] for r in got] == [["ab"], [], None, ["ab"], ["aébc", "ébcd", "bcde"]]


def test_leak_and_termination(spark):
    rows = [("ok<|im_end|>",), ("ok",), ("", ), (None,), ("a\nuser\nb<|im_end|>",), ("<|im_start|>x<|im_end|>",), (" \n ok<|im_end|> ",)]
    got = spark.createDataFrame(rows, "t string").select(T.cleanly_terminated(F.col("t")), T.prompt_leaked(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (False, False), (False, True), (False, True), (True, False)]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("t", "s", "2024-02-28", "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\nyo\n<|im_end|>")], "a string, b string, d string, r string")
    r = df.select(T.with_thinking(F.col("a"), F.col("b")), T.with_thinking(F.lit(""), F.col("b")), T.shifted_date(F.col("d"), 2), T.assistant_segments(F.col("r"))).first()
    assert tuple(r) == ("<think>\nt\n</think>\n\ns", "s", "2024-03-01", ["hi", "yo\n"])


@pytest.mark.parametrize(
    ("text", "names", "sources", "invalid"),
    [
        ('<tool_call>{"name":"f","arguments":{"a":1}}</tool_call>', ["f"], ["native"], 0),
        ('<tool_call>[{"name":"f"},{"name":"g"}]</tool_call>', ["f", "g"], ["native"] * 2, 0),
        ('<tool_call>{"function":{"name":"f","arguments":"{\\"a\\":1}"}}</tool_call>', ["f"], ["native"], 0),
        ('<tool_call>{"name":"f","arguments":{', [], [], 1),
        ('<tool_call>{"name":"f","arguments":{"a":1},}', ["f"], ["native"], 0),
        ('x\n```json\n{"name":"f"}\n```', ["f"], ["fenced"], 0),
        ('{"name":"f"} [{"name":"g"}]{"other":1} {"name":"h"}', ["f", "g"], ["bare"] * 2, 0),
        ('{"name":"f","parameters":{}}', [], [], 0),
        ('{"name":"f","arguments":{"parameters":1}}', ["f"], ["bare"], 0),
        ('{"name":"f","arguments":"nope"}', ["f"], ["bare"], 0),
        ("plain text", [], [], 0),
        ("", [], [], 0),
        (None, [], [], 0),
    ],
)
def test_parse(text, names, sources, invalid):
    got = parse(text)
    assert [c["name"] for c in got["calls"]] == names and [c["source"] for c in got["calls"]] == sources and len(got["invalid_blocks"]) == invalid


def test_parse_as_column(spark):
    rows = [('<tool_call>{"name":"f","arguments":{"a":"ü"}}</tool_call>',), (None,)]
    got = spark.createDataFrame(rows, "t string").select(parse_tool_calls("t").alias("p")).collect()
    assert json.loads(got[0].p.calls[0].arguments) == {"a": "ü"} and got[1].p.calls == []


def test_comparable_values():
    assert comparable(" Paris。") == "paris" and comparable("1_000") == 1000.0 and comparable("3d") == "3d" and comparable("３") == 3.0
    assert comparable([2, 1]) == [1, 2] and comparable([1, "x"]) == [1, "x"] and comparable({"K": "A"}) == {"K": "a"}
    assert comparable("inf") == float("inf") and comparable("nan") != comparable("nan")


def _call(name, **arguments):
    return {"name": name, "arguments": arguments}


def test_assignment_takes_most_equal_then_first():
    assert assign([_call("f", a=1), _call("f", a=2)], [_call("f", a=2), _call("f", a=1)]) == [1, 0]
    assert assign([_call("f", a=1)], [_call("g", a=1)]) == [-1]
    assert assign([_call("f", a=1)], [_call("f"), _call("f")]) == [0]


def _native(*calls):
    return "".join(f"<tool_call>{json.dumps(c)}</tool_call>" for c in calls) + "<|im_end|>"


def test_scores():
    def one(mode, expected, text, stopped=None):
        return score(mode, expected, parse(text), text, stopped=stopped)

    good = one("tool", [_call("f", a="1")], _native(_call("f", a=1)))
    assert good["overall"] and good["strict_protocol_success"] and good["canonical_format"] and good["arg_key_accuracy"] == 1
    assert not one("tool", [_call("f", a="1")], _native(_call("f", a=1)), stopped=False)["strict_protocol_success"]
    extra = one("tool", [_call("f")], _native(_call("f", b=1)))
    assert extra["extra_argument"] and not extra["overall"] and extra["arg_key_accuracy"] == 1
    null = one("tool", [_call("f", a=None)], _native(_call("f")))  # a missing argument equals an expected null
    assert null["arg_exact_match"] and null["missing_argument"]
    fenced = one("tool", [_call("f")], '```json\n{"name":"f"}\n```')
    assert fenced["overall"] and not fenced["strict_protocol_success"] and not fenced["canonical_format"]
    missing = one("tool", [_call("f"), _call("f")], _native(_call("f")))
    assert missing["missing_argument"] and missing["wrong_tool"] and missing["arg_key_accuracy"] == 0.5
    quiet = one("no_tool", [], "no<|im_end|>")
    assert quiet["overall"] and quiet["strict_protocol_success"] and quiet["no_tool_correct"]
    assert one("no_tool", [], _native(_call("f")))["wrong_tool"]


def test_tool_shapes():
    wrapped = {"type": "function", "function": {"name": "f"}}
    assert wrap_tool(wrapped) is wrapped
    assert wrap_tool({"name": "f", "parameters": {"type": "object", "properties": {}}})["function"]["parameters"] == {"type": "object", "properties": {}}
    lifted = wrap_tool({"name": "f", "parameters": {"a": {"type": "string", "required": True}, "b": "text"}})["function"]["parameters"]
    assert lifted == {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "string", "description": "text"}}, "required": ["a"]}
    listed = wrap_tool({"name": "f", "parameters": [{"name": "a", "required": True}, {"parameter": "b"}, 3]})["function"]["parameters"]
    assert list(listed["properties"]) == ["a", "b"] and listed["required"] == ["a"]
    assert wrap_tool({"parameters": 3})["function"] == {"name": "unknown", "description": "", "parameters": {"type": "object", "properties": {}}}
    assert make_call("f", "{bad") == _call("f", raw="{bad") and make_call("f", "[1]") == _call("f", value=[1])
    given = {"name": "f", "parameters": {"properties": {"a": {"type": ["null", "float"]}, "b": {"type": "list", "array_item_type": "dict"}}, "required": []}}
    assert schema_function(given)["function"]["parameters"] == {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "array", "items": {"type": "object"}}}}
    assert [accepted_value(x) for x in (["", None], ["", 0], [False], "x", [])] == [None, 0, False, "x", None]


def test_rows_are_worked_on_in_slices_and_once(spark, tmp_path):
    """Equal short rows are one call; long ones aren't kept; results are in their places, nulls and nested values too."""
    from tessella.functions import batched

    log = tmp_path / "calls"
    log.mkdir()

    def noted(text, calls):
        (log / f"{len(list(log.iterdir()))}").write_text("")
        return {"n": None if text is None else len(text), "names": None if calls is None else [c["name"] for c in calls]}

    longer = "x" * (batched.KEPT_CHARS + 1)
    rows = [(i, [None, "", "ab", longer][i % 4], [None, [], [("f", "1"), ("g", None)]][i % 3]) for i in range(2400)]
    df = spark.createDataFrame(rows, "i int, t string, c array<struct<name: string, arguments: string>>").coalesce(1)
    got = df.select("i", batched.rowwise("struct<n: int, names: array<string>>")(noted)("t", "c").alias("r")).collect()
    assert all((r.r.n, r.r.names) == (None if t is None else len(t), None if c is None else [x[0] for x in c]) for r, (_, t, c) in zip(sorted(got), rows, strict=True))
    assert len(list(log.iterdir())) <= 9 + 600


def test_batches_of_long_texts_are_short(spark):
    import pyarrow as pa

    from tessella import session

    session.ready(spark)
    long = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 50000) AS t")  # 20 MB in one task

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["id"])

    assert long.mapInArrow(size, "id bigint").selectExpr("max(id)").first()[0] < 100

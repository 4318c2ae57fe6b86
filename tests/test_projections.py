import json
import random

import pytest

from tessella.sources import converters
from tessella.sources.converters import CONVERTERS, PROJECTED, convert


def pick(r, *options):
    return r.choice(options)


def value(r, depth=0):
    options = [None, True, False, 0, 3, -2.5, "", "a b", 'q"\\,: é', "x\ny", [], {}]
    if depth < 2:
        options += [[value(r, depth + 1) for _ in range(r.randrange(3))], {k: value(r, depth + 1) for k in r.sample(["b", "a", "k k", "é"], r.randrange(3))}] * 3
    return r.choice(options)


def obj(r):
    return {k: value(r) for k in r.sample(["b", "a", "x:y", "z,"], r.randrange(4))}


def definition(r):
    shape = r.randrange(7)
    about = {"name": r.choice(["f", "g é", 'h"'])} if r.random() < 0.9 else {}
    about |= {"description": "d, e: f"} if r.random() < 0.6 else {}
    if shape == 0:
        return {"type": "function", "function": about | {"parameters": obj(r)}}
    if shape == 1:
        return about | {"parameters": {"type": "object", "properties": obj(r)}}
    if shape == 2:
        named = {k: r.choice([{"type": "string", "required": pick(r, True, False, 1, 0, "yes", "", None)}, {"type": "integer"}, "a text", 7, None, True]) for k in r.sample("abcd", r.randrange(4))}
        return about | {"parameters": named}
    if shape == 3:
        return about | {"parameters": [r.choice([{"name": f"p{k}", "type": "number", "required": pick(r, True, False)}, {"parameter": f"p{k}", "description": "x"}, {"description": None}, 7]) for k in range(r.randrange(3))]}
    return about | {"parameters": pick(r, None, 3, "x", [])} if shape == 4 else about


def told(r):
    return json.dumps(r.choice([{"name": "f", "arguments": obj(r)}, {"name": "g", "arguments": json.dumps(obj(r))}, {"name": "h", "arguments": pick(r, "no json", [1, "a"], 4, None, "[1]", "null")}, {"arguments": {}}, {"name": 5}, {}]), ensure_ascii=r.random() < 0.5)


def shared_turn(r):
    turn = {"from": r.choice(["human", "gpt", "function_call", "observation", "human", "gpt", "system", "other", None])}
    if turn["from"] == "function_call":
        turn["value"] = pick(r, told(r), told(r), told(r), "no json", "null", "[1]" if r.random() < 0.1 else "{}", {"name": "d", "arguments": {"a": 1}})
    elif turn["from"] == "gpt" and r.random() < 0.5:
        turn["value"] = " ".join(pick(r, "say", f"<tool_call>{told(r)}</tool_call>", f"<tool_call>\n {told(r)}\n</tool_call>\n", "<tool_call>{bad}</tool_call>", "<tool_call>") for _ in range(r.randrange(4)))
    elif r.random() < 0.95:
        turn["value"] = pick(r, "hi", "", "é\n", "x, y: z", "two  words", "more", None) if r.random() < 0.9 else "v"
    return turn


def typed_turn(r):
    turn = {"role": r.choice(["user", "assistant", "tool", "assistant", "system", "other"])}
    if r.random() < 0.9:
        turn["content"] = pick(r, "hi", "", None, {"b": [1, "x"]}, "y: z, w", [], 7)
    if turn["role"] == "assistant" and r.random() < 0.6:
        turn["tool_calls"] = pick(r, None, [], [json.loads(told(r)) and {"function": json.loads(told(r))} for _ in range(r.randrange(1, 3))], [{}], [{"function": None}], "bad" if r.random() < 0.2 else [])
    if turn["role"] == "tool" and r.random() < 0.5:
        turn["name"] = pick(r, "given", "", None)
    return turn


def row(r, name):
    turn = typed_turn if name.startswith("typed") else shared_turn
    turns = [turn(r) for _ in range(r.randrange(7))]
    if r.random() < 0.04:
        turns.append(pick(r, 3, None, "x", []))
    column = json.dumps(turns, ensure_ascii=r.random() < 0.5) if r.random() < 0.95 else pick(r, "{bad", "{}", "3", "null", None, "")
    tools = [definition(r) for _ in range(r.randrange(3))] + ([4] if r.random() < 0.03 else [])
    tools = json.dumps(tools) if r.random() < 0.9 else pick(r, None, "bad", "{}", "null", "", '"x"')
    return column, tools


def meant(messages, tools):
    """What a sample says, whatever the text of its JSON."""

    def loose(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True) if text and text[0] in "[{" else text
        except ValueError:
            return text

    def number(x):
        if isinstance(x, dict):
            return {k: number(v) for k, v in x.items()}
        if isinstance(x, list):
            return [number(v) for v in x]
        return float(x) if isinstance(x, int) and not isinstance(x, bool) else x

    calls = lambda m: [(c["name"], json.dumps(number(json.loads(c["arguments"])), sort_keys=True)) for c in m["tool_calls"] or []]
    return [(m["role"], loose(m["content"]), calls(m), m["name"]) for m in messages], [json.dumps(number(json.loads(t)), sort_keys=True) for t in tools or []]


def by_row(name, rows):
    """The row functions, one row after the other, with the converters' check."""
    out = {}
    for i, (column, tools) in enumerate(rows):
        try:
            got = CONVERTERS[name][0]({"conversations": column, "messages": column, "tools": tools})
            if got is None:
                continue
            messages, defs = got
            for m in messages:
                for c in m["tool_calls"] or []:
                    c["name"] = c["name"] if isinstance(c["name"], str) else json.dumps(c["name"])
                    c["arguments"] = json.dumps(c["arguments"])
                m["name"] = m["name"] if m["name"] is None or isinstance(m["name"], str) else json.dumps(m["name"])
        except Exception:  # a bad row is skipped
            continue
        roles = [m["role"] for m in messages]
        if len(messages) >= 2 and "user" in roles and "assistant" in roles and not any(m["role"] == "assistant" and not m["content"] and not m["tool_calls"] for m in messages):
            out[i] = meant(messages, [json.dumps(t) for t in defs] if name != "typed_messages" else [])
    return out


@pytest.mark.parametrize("name", sorted(PROJECTED))
def test_projections_are_the_row_functions(spark, name):
    r = random.Random(name)
    rows = [row(r, name) for _ in range(700)]
    df = spark.createDataFrame([(i, c, c, t, "mine", 1) for i, (c, t) in enumerate(rows)], "line_no long, conversations string, messages string, tools string, turns string, t int").repartition(3)
    got = {x.sample_id: meant([m.asDict(recursive=True) for m in x.messages], x.tools) for x in convert(df, name).collect()}
    want = by_row(name, rows)
    assert len(want) > 100
    assert got.keys() == want.keys(), [(i, rows[i]) for i in list(got.keys() ^ want.keys())[:3]]
    for i in want:
        assert got[i] == want[i], rows[i]


def test_no_python_worker(spark):
    df = spark.createDataFrame([(1, "[]", "[]", "[]", "a", "b", "c")], "line_no long, conversations string, messages string, tools string, problem string, thinking string, solution string")
    for name in [*PROJECTED, "reasoning"]:
        plan = convert(df, name)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_nested_columns_and_missing_tools(spark):
    df = spark.sql("SELECT 4L AS line_no, array(named_struct('from', 'human', 'value', 'q'), named_struct('from', 'function_call', 'value', '{\"name\": \"f\"}'), named_struct('from', 'observation', 'value', 'r')) AS conversations")
    (got,) = convert(df, "share_gpt_zh").collect()
    assert [(m.role, m.content, m.name) for m in got.messages] == [("user", "q", None), ("assistant", None, None), ("tool", "r", "f")] and got.tools is None
    both = convert(df.selectExpr("line_no", "conversations", "array(named_struct('name', 'f')) AS tools"), "share_gpt_en").first()
    assert both.messages[0].content == converters.SYSTEM_EN and json.loads(both.tools[0])["function"]["name"] == "f"
    assert convert(df.limit(0), "share_gpt_zh").count() == 0
    deep = spark.createDataFrame([(1, "[" * 3000, None), (2, None, None)], "line_no long, conversations string, tools string")
    assert convert(deep, "tagged_calls").count() == 0

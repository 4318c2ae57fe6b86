"""Lenient extraction of tool calls from generated text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import takewhile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessella.functions.batched import rowwise
from tessella.functions.openjson import leading, loads
from tessella.schemas import PARSED

# How generated text marks calls, which decides what is a call. Blocks between tags (the last one may
# be open), fenced blocks, fences left at a block's ends, and commas before a closing bracket, also inside strings.
OPEN, CLOSE, FENCE = "<tool_call>", "</tool_call>", "```"
_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_FENCE_ENDS = re.compile(r"\A```(?:json)?\s*|\s*```\Z")
_COMMA = re.compile(r",\s*([}\]])")

_BRACE = re.compile(r"[{}]")


def _balanced(text: str) -> str:
    """From the first opening brace to the one that closes it, whatever is quoted; empty if there is none."""
    begin, depth = text.find("{"), 0
    for brace in _BRACE.finditer(text, begin) if begin >= 0 else ():
        depth += 1 if brace[0] == "{" else -1
        if not depth:
            return text[begin : brace.end()]
    return ""


def readings(text: str) -> Iterator:
    """What a text may mean as JSON: with trailing commas forgiven, else as its first balanced object."""
    text = _COMMA.sub(r"\1", text.strip())
    for part in (text, _balanced(text)):
        try:
            yield loads(part)
            return
        except ValueError:
            continue


def loose_json(text: str):
    """The first reading of a text; None if it has none."""
    return next(readings(text), None)


def is_definition(obj: dict) -> bool:
    """Whether an object describes a tool rather than calls one."""
    return any(isinstance(x, dict) and "parameters" in x and "arguments" not in x for x in (obj.get("function"), obj))


def _arguments(given) -> tuple[dict, bool]:
    """A call's arguments as an object, and whether they were one (as such or as text)."""
    match given:
        case dict():
            return given, True
        case str():
            got = loose_json(given)
            return (got, True) if isinstance(got, dict) else ({}, False)
    return {"value": given}, False


def calls_in(value) -> list[dict]:
    """The calls among an object or a list of objects: name, arguments (an object), valid_json, raw."""
    out = []
    for obj in value if isinstance(value, list) else [value]:
        if not isinstance(obj, dict) or is_definition(obj):
            continue
        body = obj["function"] if isinstance(obj.get("function"), dict) else obj
        name = body.get("name") or obj.get("name")
        if isinstance(name, str) and name:
            arguments, valid = _arguments(body.get("arguments", {}))
            out.append({"name": name, "arguments": arguments, "valid_json": valid, "raw": json.dumps(obj, ensure_ascii=False)})
    return out


def block_calls(block: str) -> tuple[list[dict], bool]:
    """The calls of one block, and whether it was good: JSON as it stands, or forgiven with arguments that are all valid."""
    block = _FENCE_ENDS.sub("", block.strip()).strip()
    try:
        strict = calls_in(loads(block))
    except ValueError:
        strict = []
    calls = strict or calls_in(loose_json(block))
    return calls, bool(strict) or (bool(calls) and all(c["valid_json"] for c in calls))


def tagged(text: str) -> list[str]:
    """What stands between tags, trimmed, without empty blocks; the last block may lack its closing tag."""
    blocks, at = [], text.find(OPEN)
    while at >= 0:
        end = text.find(CLOSE, at)
        blocks.append(text[at + len(OPEN) : end if end >= 0 else len(text)].strip())
        at = text.find(OPEN, end + len(CLOSE)) if end >= 0 else -1
    return [b for b in blocks if b]


def _only_calls(value) -> list[dict]:
    """The calls of a value that is a call, or a list of nothing but calls; else none."""
    found = calls_in(value)
    return found if len(found) == (len(value) if isinstance(value, list) else 1) else []


def parse(text: str | None) -> dict:
    """calls (each with its source: native, fenced or bare) and invalid_blocks. The first source with anything wins."""
    calls: list[dict] = []
    invalid: list[str] = []

    def take(blocks: list[str], source: str, empty_is_invalid: bool) -> None:
        for block in blocks:
            found, good = block_calls(block)
            calls.extend(c | {"source": source} for c in found)
            if not good and (found or empty_is_invalid):
                invalid.append(block)

    text = text or ""
    take(tagged(text), "native", True)
    if not calls and not invalid:
        take(_FENCED.findall(text), "fenced", False)
    if not calls and not invalid:
        for found in takewhile(bool, map(_only_calls, leading(text))):
            calls.extend(c | {"source": "bare"} for c in found)
    return {"calls": calls, "invalid_blocks": invalid}


def as_row(parsed: dict) -> dict:
    return {"calls": [c | {"arguments": json.dumps(c["arguments"], ensure_ascii=False)} for c in parsed["calls"]], "invalid_blocks": parsed["invalid_blocks"]}


@rowwise(PARSED)
def _parsed(text: str | None) -> dict:
    return as_row(parse(text))


def with_marks(text: Column) -> Column:
    """The text if it can hold calls at all: it has a tag or a fence, or begins with a bracket. Else null."""
    can = text.contains(OPEN) | text.contains(FENCE) | text.rlike(r"\A[ \t\r\n]*+[\[{]")
    return F.when(can, text)


def parse_tool_calls(text: str | Column) -> Column:
    """calls and invalid_blocks of a text. A text without any mark of a call is not handed to Python, only its absence is."""
    return _parsed(with_marks(F.col(text) if isinstance(text, str) else text))


# -- one row per call


def calls_table():
    """The calls of a text as a table function: call_no from 0, name, arguments (JSON text), valid_json, source, raw.

    Used laterally; a null text, and one without calls, has no rows. Rows travel in Arrow batches.
    """

    class ToolCalls:
        def eval(self, text: str):
            for k, c in enumerate(as_row(parse(text))["calls"]):
                yield k, c["name"], c["arguments"], c["valid_json"], c["source"], c["raw"]

    return F.udtf(ToolCalls, returnType="call_no int, name string, arguments string, valid_json boolean, source string, raw string", useArrow=True)


def register_calls(spark: SparkSession, name: str = "tool_calls") -> None:
    """Let SQL use it: ``SELECT t.id, c.* FROM t, LATERAL tool_calls(t.text) c``."""
    spark.udtf.register(name, calls_table())


def all_native(parsed: str = "parsed"):
    return F.expr(f"size({parsed}.calls) > 0 and forall({parsed}.calls, c -> c.source = 'native')")


def names(parsed: str = "parsed"):
    return F.expr(f"transform({parsed}.calls, c -> c.name)")

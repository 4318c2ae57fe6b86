"""Sources of differing shapes as samples of one shape.

Each converter takes a row's JSON columns and gives messages and tools, or nothing if the row is unfit; a bad
row is skipped, never fatal. The per-row logic walks open JSON, so it is Python in Arrow batches; columns that
a converter doesn't name are pruned from the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.openjson import loads
from tessella.functions.tools import make_call, wrap_tool
from tessella.operators.samples import is_convertible
from tessella.schemas import CALL, MESSAGE
from tessella.session import ready, written
from tessella.sources.files import capped
from tessella.sources.projections import project, sources

# The system texts of samples with tools.
SYSTEM_EN = "You are a helpful assistant with access to tools."
SYSTEM_ZH = "你是一个有用的助手，可以调用工具来帮助用户完成任务。"

# What counts as a call between tags, and as a definition or a list of them inside a prompt. Which rows
# a source gives depends on exactly these.
_CALL = re.compile(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", re.S)
_DEFINITION = re.compile(r'\{[^{}]*"function"[^{}]*"description"[^{}]*\}')
_ARRAY = re.compile(r"\[(\{[^[\]]*\}(?:,\s*\{[^[\]]*\})*)\]")


def _message(role: str, content, calls: list[dict] | None = None, name: str | None = None) -> dict:
    if content is not None and not isinstance(content, str):
        content = json.dumps(content, ensure_ascii=False)
    return {"role": role, "content": content, "tool_calls": calls, "name": name}


def _json(value, default=None):
    if not isinstance(value, str):
        return default if value is None else value
    try:
        return loads(value)
    except ValueError:
        return default


def _tools(value) -> list[dict]:
    got = _json(value, [])
    return [wrap_tool(t) for t in got] if isinstance(got, list) else []


def _latest_name(messages: list[dict]) -> str:
    """Name of the latest call so far."""
    return next((m["tool_calls"][0]["name"] for m in reversed(messages) if m["tool_calls"]), "")


def prompt_response(row: dict):
    """systemPrompt, userPrompt, assistantResponse: definitions inside the prompt, calls as JSON in the response."""
    prompt, user, answer = (row.get(k) or "" for k in ("systemPrompt", "userPrompt", "assistantResponse"))
    if not user or not answer:
        return None
    tools = _prompt_tools(prompt)
    reply = _json(answer)
    calls: list[dict] = []
    if isinstance(reply, dict):
        calls = [_reply_call(reply, {})]
    elif isinstance(reply, list):
        calls = [_reply_call(x, []) for x in reply if isinstance(x, dict) and "function" in x]
    said = _message("assistant", None, calls) if calls else _message("assistant", answer)
    return [*([_message("system", SYSTEM_ZH)] if tools else []), _message("user", user), said], tools


def _prompt_tools(prompt: str) -> list[dict]:
    """Definitions that stand alone in a prompt; if none does, those inside its arrays."""
    alone = [x for x in map(_json, _DEFINITION.findall(prompt)) if isinstance(x, dict)]
    if alone:
        return list(map(wrap_tool, alone))
    inside = (x for array in _ARRAY.findall(prompt) for x in _json(f"[{array}]", []))
    return [wrap_tool(x) for x in inside if isinstance(x, dict) and not {"function", "name"}.isdisjoint(x)]


def _reply_call(reply: dict, empty) -> dict:
    """A reply's object as a call. Of a list of arguments the first counts if it is an object; ``empty`` stands for no list."""
    arguments = reply.get("arguments", {})
    if isinstance(arguments, list):
        first = arguments[0] if arguments else empty
        arguments = first if not arguments or isinstance(first, dict) else {"args": arguments}
    return make_call(reply.get("function", "unknown"), arguments)


def _share_gpt(row: dict, system: str):
    tools = _tools(row.get("tools"))
    messages = [_message("system", system)] if tools else []
    for turn in _json(row.get("conversations"), []):
        kind, value = turn.get("from", ""), turn.get("value", "")
        if kind in ("human", "gpt"):
            messages.append(_message("user" if kind == "human" else "assistant", value))
        elif kind == "function_call":
            got = _json(value)
            if isinstance(got, dict):
                messages.append(_message("assistant", None, [make_call(got.get("name", "unknown"), got.get("arguments", {}))]))
            elif got is None:
                messages.append(_message("assistant", value))
            else:
                return None
        elif kind == "observation":
            messages.append(_message("tool", value, name=_latest_name(messages)))
    return messages, tools


def share_gpt_zh(row: dict):
    """conversations of from and value, and tools: with Chinese system text."""
    return _share_gpt(row, SYSTEM_ZH)


def share_gpt_en(row: dict):
    """The same with English system text."""
    return _share_gpt(row, SYSTEM_EN)


def tagged_calls(row: dict):
    """conversations whose assistant texts hold calls between tags; what else they say stays as content. Other roles go."""
    tools = _tools(row.get("tools"))
    messages = []
    for turn in _json(row.get("conversations"), []):
        kind, value = turn.get("from", ""), turn.get("value", "")
        if kind == "system":
            messages.append(_message("system", SYSTEM_EN if tools else value))
        elif kind == "human":
            messages.append(_message("user", value))
        elif kind == "gpt":
            found = [x for x in map(_json, _CALL.findall(value)) if x is not None]
            calls = [make_call(x.get("name", "unknown"), x.get("arguments", {})) for x in found]
            messages.append(_message("assistant", _CALL.sub("", value).strip() or None, calls) if calls else _message("assistant", value))
    return messages, tools


def _typed_turns(turns: list[dict], system: bool) -> list[dict]:
    messages = []
    for turn in turns:
        role, content = turn.get("role", ""), turn.get("content", "")
        content = "null" if content is None else content
        if role == "user" or (role == "system" and system):
            messages.append(_message(role, content))
        elif role == "assistant":
            given = turn.get("tool_calls") or []
            calls = [make_call((c.get("function") or {}).get("name", "unknown"), (c.get("function") or {}).get("arguments", {})) for c in given]
            messages.append(_message(role, None, calls) if calls else _message(role, content))
        elif role == "tool":
            messages.append(_message(role, content, name=turn.get("name") or _latest_name(messages)))
    return messages


def typed_with_tools(row: dict):
    """tools and conversations as JSON text, turns with role, content, tool_calls and name."""
    tools, turns = _tools(row.get("tools")), _json(row.get("conversations"))
    if not isinstance(turns, list):
        return None
    return ([_message("system", SYSTEM_EN)] if tools else []) + _typed_turns(turns, False), tools


def typed_messages(row: dict):
    """messages with role, content, tool_calls and name; tool definitions are dropped."""
    turns = _json(row.get("messages"), [])
    return (_typed_turns(turns, True), []) if turns else None


def reasoning(row: dict):
    """problem, thinking, solution."""
    problem, thinking, solution = (row.get(k) or "" for k in ("problem", "thinking", "solution"))
    if not problem or not solution:
        return None
    text = f"<think>\n{thinking}\n</think>\n\n{solution}" if thinking else solution
    return [_message("user", problem), _message("assistant", text)], []


#: Sources that are projections; the row functions say the same for one row at a time.
PROJECTED = sources(SYSTEM_EN, SYSTEM_ZH)

#: name -> (row function, the columns it reads)
CONVERTERS: dict[str, tuple[Callable, list[str]]] = {
    "prompt_response": (prompt_response, ["systemPrompt", "userPrompt", "assistantResponse"]),
    "share_gpt_zh": (share_gpt_zh, ["conversations", "tools"]),
    "share_gpt_en": (share_gpt_en, ["conversations", "tools"]),
    "tagged_calls": (tagged_calls, ["conversations", "tools"]),
    "typed_with_tools": (typed_with_tools, ["conversations", "tools"]),
    "reasoning": (reasoning, ["problem", "thinking", "solution"]),
    "typed_messages": (typed_messages, ["messages"]),
}


def _reasoning(df: DataFrame, own: Column) -> DataFrame:
    """:func:`reasoning` over columns of text: a plain projection."""
    problem, thinking, solution = (F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in CONVERTERS["reasoning"][1])
    said = F.concat(F.when(thinking != "", F.concat(F.lit("<think>\n"), thinking, F.lit("\n</think>\n\n"))).otherwise(""), solution)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"), F.lit(None).cast("string").alias("name"))
    out = df.where((problem != "") & (solution != ""))
    return out.select(own.alias("sample_id"), F.lit("reasoning").alias("source"), F.array(message("user", problem), message("assistant", said)).alias("messages"), F.lit(None).cast("array<string>").alias("tools"))


def convert(df: DataFrame, name: str, id_col: str = "line_no", cap: int | None = None) -> DataFrame:
    """Samples of one source: sample_id, source, messages, tools. Nested columns are handed over as JSON text.

    ``id_col`` numbers the rows; it is given when they are read (``files.numbered_lines``), as a number made here
    would change with the files' splits. A cap takes the rows with the smallest numbers.
    """
    spark = df.sparkSession
    ready(spark)
    function, columns = CONVERTERS[name]
    df = capped(df, cap, id_col)
    own = F.col(id_col).cast("long")
    if name == "reasoning" and all(k == "string" for c, k in df.dtypes if c in columns):
        return _reasoning(df, own).where(is_convertible())
    if name in PROJECTED:
        return project(df, PROJECTED[name], own, name).where(is_convertible())
    plain = {c: k for c, k in df.dtypes}
    given = [F.col(c) if plain[c] == "string" else F.to_json(c) for c in columns if c in plain]
    narrow = df.select(own.alias("sample_id"), *(g.alias(c) for g, c in zip(given, [c for c in columns if c in plain], strict=True)))
    kind = pa.struct([("name", pa.string()), ("arguments", pa.string())])
    message = pa.struct([("role", pa.string()), ("content", pa.string()), ("tool_calls", pa.list_(kind)), ("name", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, messages, tools = [], [], []
            for row in batch.to_pylist():
                try:
                    got = function(row)
                    if got is None:
                        continue
                    for m in got[0]:
                        for c in m["tool_calls"] or []:
                            c["name"] = c["name"] if isinstance(c["name"], str) else json.dumps(c["name"])
                            c["arguments"] = json.dumps(c["arguments"], ensure_ascii=False)
                    texts = [json.dumps(t, ensure_ascii=False) for t in got[1]] or None
                except Exception:  # a bad row is skipped
                    continue
                ids.append(row["sample_id"])
                messages.append(got[0])
                tools.append(texts)
            yield _typed(ids, messages, tools)

    def _typed(ids: list, messages: list, tools: list) -> pa.RecordBatch:
        """The rows as Arrow; only if some don't fit the types they are tried one by one."""
        try:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(messages, pa.list_(message)), pa.array(tools, pa.list_(pa.string()))], ["sample_id", "messages", "tools"])
        except (pa.ArrowException, TypeError, ValueError):
            return _typed(*map(list, zip(*(r for r in zip(ids, messages, tools, strict=True) if fits(r[1])), strict=True))) if any(fits(m) for m in messages) else _typed([], [], [])

    def fits(one: list) -> bool:
        try:
            pa.array([one], pa.list_(message))
        except (pa.ArrowException, TypeError, ValueError):
            return False
        return True

    out = narrow.mapInArrow(work, f"sample_id bigint, messages array<{MESSAGE}>, tools array<string>")
    return out.where(is_convertible()).select("sample_id", F.lit(name).alias("source"), "messages", "tools")


def convert_all(sources: dict[str, Callable[[], DataFrame]], only: list[str] | None = None, cap: int | None = None, id_col: str = "line_no") -> tuple[DataFrame | None, dict[str, str]]:
    """The union of all wanted sources, and what failed. A source that can't be read whole counts no rows and stops
    nothing: each one's samples are written once, inside its own guard, and the union reads what was written."""
    out, failed = None, {}
    for name, read in sources.items():
        if only and name not in only:
            continue
        try:
            part = written(convert(read(), name, id_col, cap), "samples")
        except Exception as e:  # whatever is wrong with one source
            failed[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
            continue
        out = part if out is None else out.unionByName(part)
    return out, failed

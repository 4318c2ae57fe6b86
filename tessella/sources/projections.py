"""Sources of conversations as samples by projections over VARIANT: no Python worker sees a row.

A source is data: where its turns are, which role each kind of turn has, and how a turn tells its calls. The text of
JSON values is VARIANT's with a space after each colon and comma: keys in order, whole numbers without a point.

Defined results. A column may be JSON text, or nested columns. A row is skipped whose turns are no list of objects, whose
tools hold anything but objects, or one of whose calls is no object; unreadable or missing tools are none. Text with a key
twice in one object, and text nested beyond what VARIANT holds, is unreadable. Halves of surrogate pairs are read as question marks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.schemas import CALL

# -- JSON text


def kind(v: str) -> str:
    return f"coalesce(schema_of_variant({v}), 'MISSING')"


def is_object(v: str) -> str:
    return f"{kind(v)} LIKE 'OBJECT%'"


def is_list(v: str) -> str:
    return f"{kind(v)} LIKE 'ARRAY%'"


def spaced(v: str) -> str:
    """A value's JSON with a space after each colon and comma outside of texts."""
    return rf"""regexp_replace(to_json({v}), '\\G((?:"(?:[^"\\\\]|\\\\.)*+"|[^",:])*+)([,:])', '$1$2 ')"""


def quoted(text: str) -> str:
    """A text as JSON."""
    one = f"to_json(array({text}))"
    return f"substring({one}, 2, length({one}) - 2)"


def as_text(v: str) -> str:
    """A text's own characters, any other value's JSON; null for null and nothing."""
    return f"CASE WHEN {kind(v)} = 'STRING' THEN try_variant_get({v}, '$', 'string') WHEN {kind(v)} NOT IN ('VOID', 'MISSING') THEN {spaced(v)} END"


def field(v: str, name: str) -> str:
    return f"try_variant_get({v}, '$.{name}', 'variant')"


def read(column: str) -> str:
    """Text as JSON, or null."""
    return f"try_parse_json({column})"


def truthy(v: str) -> str:
    return f"""({kind(v)} <> 'MISSING' AND to_json({v}) NOT IN ('false', '0', '""', '[]', '{{}}', 'null', '0.0', '-0.0'))"""


# -- calls and tools


def arguments(v: str) -> str:
    """A call's arguments as JSON text of an object: text that is no JSON under raw, what is no object under value; nothing is an empty one."""
    text = f"try_variant_get({v}, '$', 'string')"
    inner = read(text)
    inside = f"CASE WHEN {inner} IS NULL THEN concat('{{\"raw\": ', {quoted(text)}, '}}') WHEN {is_object(inner)} THEN {spaced(inner)} ELSE concat('{{\"value\": ', {spaced(inner)}, '}}') END"
    return f"CASE WHEN {kind(v)} = 'MISSING' THEN '{{}}' WHEN {kind(v)} = 'STRING' THEN {inside} WHEN {is_object(v)} THEN {spaced(v)} ELSE concat('{{\"value\": ', {spaced(v)}, '}}') END"


def call(v: str) -> str:
    """An object with name and arguments as a call."""
    name = field(v, "name")
    named = f"CASE WHEN {kind(name)} = 'MISSING' THEN 'unknown' WHEN {kind(name)} = 'STRING' THEN try_variant_get({name}, '$', 'string') ELSE {spaced(name)} END"
    return f"named_struct('name', {named}, 'arguments', {arguments(field(v, 'arguments'))})"


def said(v: str) -> str:
    """What a bare description says: text as it is, true, false and null by their names there."""
    return f"CASE {kind(v)} WHEN 'STRING' THEN try_variant_get({v}, '$', 'string') WHEN 'BOOLEAN' THEN if(try_variant_get({v}, '$', 'boolean'), 'True', 'False') WHEN 'VOID' THEN 'None' ELSE {spaced(v)} END"


def _schema(properties: str, needed: str) -> str:
    """JSON of an object schema from arrays of text: properties (name: schema) and the names that are required."""
    return f"""concat('{{"type": "object", "properties": {{', array_join({properties}, ', '), '}}', if(size({needed}) > 0, concat(', "required": [', array_join({needed}, ', '), ']'), ''), '}}')"""


def tool(v: str) -> str:
    """Any of five shapes of definition as JSON text of one."""
    p = field(v, "parameters")
    entries = f"map_entries(try_cast({p} AS map<string, variant>))"
    need = truthy(field("e.value", "required"))
    rest = f"concat('{{', array_join(transform(map_entries(map_filter(try_cast(e.value AS map<string, variant>), (k, _) -> k <> 'required')), i -> concat({quoted('i.key')}, ': ', {spaced('i.value')})), ', '), '}}')"
    one = f"""CASE WHEN NOT {is_object('e.value')} THEN concat('{{"type": "string", "description": ', {quoted(said('e.value'))}, '}}') WHEN {need} THEN {rest} ELSE {spaced('e.value')} END"""
    by_name = _schema(f"transform({entries}, e -> concat({quoted('e.key')}, ': ', {one}))", f"transform(filter({entries}, e -> {is_object('e.value')} AND {need}), e -> {quoted('e.key')})")
    listed = f"filter(try_cast({p} AS array<variant>), o -> {is_object('o')})"
    title = f"coalesce({as_text(field('o', 'name'))}, {as_text(field('o', 'parameter'))}, 'unknown')"
    given = lambda name, default: f"coalesce({spaced(field('o', name))}, '{default}')"
    by_place = _schema(f"""transform({listed}, o -> concat({quoted(title)}, ': {{"type": ', {given('type', '"string"')}, ', "description": ', {given('description', '""')}, '}}'))""", f"transform(filter({listed}, o -> {truthy(field('o', 'required'))}), o -> {quoted(title)})")
    is_schema = f"{kind(field(p, 'type'))} <> 'MISSING' AND {kind(field(p, 'properties'))} <> 'MISSING'"
    parameters = f"""CASE WHEN {is_object(p)} AND {is_schema} THEN {spaced(p)} WHEN {is_object(p)} THEN {by_name} WHEN {is_list(p)} THEN {by_place} ELSE '{{"type": "object", "properties": {{}}}}' END"""
    about = f"""concat('{{"type": "function", "function": {{"name": ', coalesce({spaced(field(v, 'name'))}, '"unknown"'), ', "description": ', coalesce({spaced(field(v, 'description'))}, '""'), ', "parameters": ', {parameters}, '}}}}')"""
    return f"CASE WHEN try_variant_get({v}, '$.type', 'string') = 'function' AND {kind(field(v, 'function'))} <> 'MISSING' THEN {spaced(v)} ELSE {about} END"


# -- turns


def message(role: str, content: str, calls: str = "null", name: str = "null") -> str:
    return f"named_struct('role', {role}, 'content', {content}, 'tool_calls', cast({calls} AS array<{CALL}>), 'name', cast({name} AS string))"


_ARRAY = f"cast(array() AS array<{CALL}>)"


@dataclass(frozen=True)
class Source:
    """turns and tools: columns (no tools: they are dropped); kind and text: fields of a turn; roles: kind -> role.

    calls: SQL over a turn ``t`` -> its calls (null: it tells none), for turns of ``calling``; plain: SQL -> the text that such
    a turn keeps beside calls (null: none); strict: whether a row goes in which such a turn is neither a call nor text.
    system: the text that stands for the system's if there are tools; a source's own system turns go if it is given first.
    """

    turns: str
    kind: str
    text: str
    roles: dict[str, str]
    calling: str
    calls: Callable[[str, str], str]
    tools: str | None = "tools"
    system: str | None = None
    own_system: bool = False
    plain: Callable[[str], str] | None = None
    wrong: Callable[[str], str] | None = None
    null_text: str = "null"


def _value(t: str, s: Source) -> str:
    """A turn's text: an empty one if it has none."""
    v = field(t, s.text)
    return f"CASE WHEN {kind(v)} = 'MISSING' THEN '' WHEN {kind(v)} = 'VOID' THEN {s.null_text} ELSE {as_text(v)} END"


def project(df: DataFrame, s: Source, own: Column, name: str) -> DataFrame:
    """sample_id, source, messages, tools of every row that can be read."""
    types = dict(df.dtypes)

    def variant(column: str | None) -> Column:
        if column is None or column not in types:
            return F.expr("cast(null AS variant)")
        if types[column] == "variant":
            return F.col(column)
        return F.expr(read(f"`{column}`") if types[column] == "string" else f"to_variant_object(`{column}`)")

    rows = df.select(own.alias("sample_id"), variant(s.turns).alias("c"), variant(s.tools).alias("d"))
    rows = rows.where(F.expr(is_list("c"))).selectExpr("sample_id", "try_cast(c AS array<variant>) AS turns", f"if({is_list('d')}, try_cast(d AS array<variant>), array()) AS tools")
    rows = rows.where(F.expr(f"forall(turns, t -> {is_object('t')}) AND forall(tools, t -> {is_object('t')})"))
    # What each turn is: its role, its text and its calls.
    what = f"coalesce(try_variant_get(t, '$.{s.kind}', 'string'), '')"
    role = "CASE " + what + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in s.roles.items()) + " END"
    calls = f"if({what} = '{s.calling}', {s.calls('t', _value('t', s))}, null)"
    rows = rows.selectExpr("sample_id", "tools", "turns", f"transform(turns, t -> named_struct('t', t, 'role', {role}, 'text', {_value('t', s)}, 'calls', {calls})) AS turned")
    if s.wrong:
        rows = rows.where(F.expr(f"NOT exists(turns, t -> {what} = '{s.calling}' AND {s.wrong('t')})"))
    rows = rows.selectExpr("sample_id", "tools", "filter(turned, x -> x.role IS NOT NULL) AS turned")
    kept = s.plain("x.text") if s.plain else "null"
    latest = "coalesce(try_element_at(array_compact(transform(slice(turned, 1, i), y -> get(y.calls, 0).name)), -1), '')"
    own_name = "nullif(" + as_text(field("x.t", "name")) + ", '')" if s.null_text != "null" else "null"
    turned = f"""transform(turned, (x, i) -> CASE WHEN size(x.calls) > 0 THEN {message('x.role', kept, 'x.calls')}
        WHEN x.role = 'tool' THEN {message('x.role', 'x.text', name=f'coalesce({own_name}, {latest})')}
        WHEN x.role = 'system' AND {'true' if s.own_system and s.system else 'false'} AND size(tools) > 0 THEN {message('x.role', _quote(s.system or ''))} ELSE {message('x.role', 'x.text')} END)"""
    first = f"if(size(tools) > 0, array({message(_quote('system'), _quote(s.system))}), array())" if s.system and not s.own_system else None
    messages = f"concat({first}, {turned})" if first else turned
    return rows.selectExpr("sample_id", f"'{name}' AS source", f"{messages} AS messages", f"if(size(tools) > 0, transform(tools, t -> {tool('t')}), null) AS tools")


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _told(t: str, text: str) -> str:
    """The call that a turn's text is, or nothing if the text is no JSON or null."""
    v = field(t, "value")
    got = f"if({kind(v)} = 'STRING', {read(f'''try_variant_get({v}, '$', 'string')''')}, {v})"
    return f"if({is_object(got)}, array({call(got)}), null)"


def _told_wrong(t: str) -> str:
    """Whether a turn's text is JSON of another kind than a call."""
    v = field(t, "value")
    got = f"if({kind(v)} = 'STRING', {read(f'''try_variant_get({v}, '$', 'string')''')}, {v})"
    return f"{kind(got)} NOT IN ('MISSING', 'VOID') AND NOT {is_object(got)}"


# Fixed value: a call between tags.
_TAGGED = r"'(?s)<tool_call>\\s*(\\{.*?\\})\\s*</tool_call>'"


def _tagged(t: str, text: str) -> str:
    found = f"filter(transform(regexp_extract_all({text}, {_TAGGED}, 1), j -> {read('j')}), j -> j IS NOT NULL)"
    return f"transform({found}, j -> {call('j')})"


def _typed(t: str, text: str) -> str:
    given = f"try_cast({field(t, 'tool_calls')} AS array<variant>)"
    return f"transform({given}, j -> {call(field('j', 'function'))})"


def _typed_wrong(t: str) -> str:
    v = field(t, "tool_calls")
    function = field("j", "function")
    return f"({truthy(v)} AND (NOT {is_list(v)} OR NOT forall(try_cast({v} AS array<variant>), j -> {is_object('j')} AND ({is_object(function)} OR NOT {truthy(function)}))))"


def sources(system_en: str, system_zh: str) -> dict[str, Source]:
    """name -> where its turns and calls are."""
    roles = {"human": "user", "gpt": "assistant", "function_call": "assistant", "observation": "tool"}
    shared = {"turns": "conversations", "kind": "from", "text": "value"}
    typed = {"kind": "role", "text": "content", "calling": "assistant", "calls": _typed, "wrong": _typed_wrong, "null_text": "'null'"}
    return {
        "share_gpt_zh": Source(**shared, roles=roles, calling="function_call", calls=_told, wrong=_told_wrong, system=system_zh),
        "share_gpt_en": Source(**shared, roles=roles, calling="function_call", calls=_told, wrong=_told_wrong, system=system_en),
        "tagged_calls": Source(**shared, roles={"system": "system", "human": "user", "gpt": "assistant"}, calling="gpt", calls=_tagged, system=system_en, own_system=True, plain=lambda text: rf"nullif(regexp_replace(regexp_replace({text}, {_TAGGED}, ''), '(?U)^\\s+|\\s+$', ''), '')"),
        "typed_with_tools": Source(turns="conversations", roles={r: r for r in ("user", "assistant", "tool")}, system=system_en, **typed),
        "typed_messages": Source(turns="messages", tools=None, roles={r: r for r in ("system", "user", "assistant", "tool")}, **typed),
    }

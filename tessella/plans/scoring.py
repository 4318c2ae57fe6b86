"""Queries over scores, rewards and reports: every way a case can go right or wrong."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.scoring import score_case
from tessella.functions.toolcalls import all_native, names, parse_tool_calls
from tessella.operators import metrics, rewards
from tessella.plans.base import query, table

_SCORES = ["valid_format", "canonical_format", "tool_selection_correct", "arg_key_accuracy", "arg_exact_match", "invalid_json", "missing_argument", "extra_argument", "wrong_tool", "overall", "strict_protocol_success"]


def _call(name: str, arguments) -> str:
    return json.dumps({"name": name, "arguments": arguments}, ensure_ascii=False)


def _native(*calls: str) -> str:
    return "".join(f"<tool_call>\n{c}\n</tool_call>" for c in calls) + "<|im_end|>"


#: Two calls are expected: look(a="X.", b=2) and look(a="Y").
_EXPECTED = [("look", {"a": "X.", "b": 2}), ("look", {"a": "Y"})]
_ONE, _TWO = _call("look", {"a": " x。", "b": "2"}), _call("look", {"a": "y"})
#: Raw text, and the scores in the order of ``_SCORES``: the values equal after normalising, in either order, are right.
_VARIANTS = [
    (_native(_ONE, _TWO), (True, True, True, 1.0, True, False, False, False, False, True, True)),
    (_native(_TWO, _ONE), (True, True, True, 1.0, True, False, False, False, False, True, True)),
    (_native(_ONE), (True, True, False, 0.5, False, False, True, False, True, False, False)),
    (_native(_ONE, _TWO, _call("other", {})), (True, True, False, 1.0, True, False, False, False, True, False, False)),
    (_native(_call("look", {"a": "z", "b": 2}), _TWO), (True, True, True, 1.0, False, False, False, False, False, False, False)),
    (_native(_call("look", {"a": "x", "b": 2, "c": 1}), _TWO), (True, True, True, 1.0, False, False, False, True, False, False, False)),
    (_native(_call("look", {"a": "x"}), _TWO), (True, True, True, 0.75, False, False, True, False, False, False, False)),
    (_native(_call("look", "{bad"), _TWO), (True, True, True, 0.5, False, True, True, False, False, False, False)),
    (f"```json\n[{_ONE}, {_TWO},]\n```<|im_end|>", (True, False, True, 1.0, True, False, False, False, False, True, False)),
    (f"{_ONE}\n{_TWO}\nuser\nmore<|im_end|>", (True, False, True, 1.0, True, False, False, False, False, True, False)),
    (_native(_ONE, _TWO)[: -len("<|im_end|>")], (True, True, True, 1.0, True, False, False, False, False, True, False)),
    ('<tool_call>{"name": "look", "arguments": {"a"', (False, False, False, 0.0, False, True, True, False, True, False, False)),
    ("I would look.<|im_end|>", (False, False, False, 0.0, False, False, True, False, True, False, False)),
    (_call("look", {"parameters": {"a": 1}}) + "<|im_end|>", (True, False, False, 0.0, False, False, True, True, True, False, False)),
    ('{"type": "function", "function": {"name": "look", "parameters": {}}}<|im_end|>', (False, False, False, 0.0, False, False, True, False, True, False, False)),
    (None, (False, False, False, 0.0, False, False, True, False, True, False, False)),
]


def _pick(values: list, id_col: str = "event_id"):
    return F.get(F.array(*map(F.lit, values)), (F.col(id_col) % len(values)).cast("int"))


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, bool | int | float) else "'" + v.replace("'", "''") + "'"


def _case_sql(values: list, id_col: str = "event_id") -> str:
    return f"CASE {id_col} % {len(values)} " + " ".join(f"WHEN {k} THEN {_sql(v)}" for k, v in enumerate(values)) + " END"


def _expected():
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(json.dumps(a)).alias("arguments")) for n, a in _EXPECTED))


@query("SELECT event_id, " + ", ".join(f"({_case_sql([v[1][k] for v in _VARIANTS])})::{'DOUBLE' if name == 'arg_key_accuracy' else 'BOOLEAN'} AS {name}" for k, name in enumerate(_SCORES)) + " FROM events")
def score_variants(spark, sf_dir):
    """Two expected calls against calls in either order, missing, extra, wrong, unreadable, fenced, bare, leaking and none."""
    e = table(spark, sf_dir, "events").select("event_id", _pick([v[0] for v in _VARIANTS]).alias("raw"))
    s = e.select("event_id", score_case(F.lit("tool"), _expected(), "raw", F.lit(None).cast("boolean")).alias("s"))
    return s.select("event_id", *(f"s.{name}" for name in _SCORES))


_SILENT = [("No need.<|im_end|>", True, False, True), (_native(_ONE), False, False, False), ("<tool_call>{bad<|im_end|>", True, True, True), ("No need.\nuser\nx<|im_end|>", True, False, False), ("", True, False, False)]


@query(f"SELECT event_id, ({_case_sql([v[1] for v in _SILENT])}) AS no_tool_correct, NOT ({_case_sql([v[1] for v in _SILENT])}) AS wrong_tool, ({_case_sql([v[2] for v in _SILENT])}) AS invalid_json, ({_case_sql([v[3] for v in _SILENT])}) AS strict, true AS no_key_accuracy FROM events")
def score_no_tool(spark, sf_dir):
    """No call is expected."""
    e = table(spark, sf_dir, "events").select("event_id", _pick([v[0] for v in _SILENT]).alias("raw"))
    none = F.array().cast("array<struct<name: string, arguments: string>>")
    s = e.select("event_id", score_case(F.lit("no_tool"), none, "raw", F.lit(None).cast("boolean")).alias("s"))
    return s.select("event_id", "s.no_tool_correct", "s.wrong_tool", "s.invalid_json", F.col("s.strict_protocol_success").alias("strict"), F.col("s.arg_key_accuracy").isNull().alias("no_key_accuracy"))


_STOPS = [("x<|im_end|>", None, True), ("x", None, False), ("x", True, True), ("x<|im_end|>", False, False), ("x\nassistant\ny", True, False), ("<|im_start|>x<|im_end|>", None, False), (" \n", None, False)]


@query(f"SELECT event_id, ({_case_sql([v[2] for v in _STOPS])}) AS clean_stop, ({_case_sql([v[2] if v[1] is None else v[0].endswith('<|im_end|>') and 'im_start' not in v[0] for v in _STOPS])}) AS by_text FROM events")
def stop_override(spark, sf_dir):
    """Whether generation ended on a token counts before the text, where it is known."""
    e = table(spark, sf_dir, "events").select("event_id", _pick([v[0] for v in _STOPS]).alias("raw"), _pick([v[1] for v in _STOPS]).cast("boolean").alias("stopped"))
    none = F.array().cast("array<struct<name: string, arguments: string>>")
    s = score_case(F.lit("no_tool"), none, "raw", "stopped")
    return e.select("event_id", s["clean_stop"].alias("clean_stop"), T.cleanly_terminated(F.col("raw")).alias("by_text"))




@query(f"SELECT event_id, ({_case_sql([True, True, True, False])}) AS selected, ({_case_sql([False, True, False, False])}) AS exact FROM events")
def greedy_assignment(spark, sf_dir):
    """Each expected call takes the free one of its name with most equal arguments, in order; the first of ties."""
    predicted = [
        [("look", {"a": "y", "b": 3}), ("look", {"a": "x", "b": 3})],  # the first expected takes the second one, its a is equal
        [("look", {"a": "y"}), ("look", {"a": "x", "b": 2})],
        [("look", {"a": "q"}), ("look", {"a": "y"})],  # a tie: the first expected takes the first one
        [("look", {"a": "x", "b": 2}), ("find", {"a": "y"})],
    ]
    raws = [_native(*(_call(n, a) for n, a in calls)) for calls in predicted]
    e = table(spark, sf_dir, "events").select("event_id", _pick(raws).alias("raw"))
    s = e.select("event_id", score_case(F.lit("tool"), _expected(), "raw", F.lit(None).cast("boolean")).alias("s"))
    return s.select("event_id", F.col("s.tool_selection_correct").alias("selected"), F.col("s.arg_exact_match").alias("exact"))


#: Pairs of JSON values, and whether they are the same argument.
_EQUAL = [
    ('"Oslo. "', '"oslo"', True), ('"3"', "3", True), ('"3.0!"', "3", True), ('"1_000"', "1000", True), ('"3d"', "3", False), ("[2, 1]", "[1, 2]", True), ('["b", 1]', '[1, "b"]', False),
    ('{"x": "A"}', '{"x": "a"}', True), ('{"x": 1}', '{"y": 1}', False), ("null", "null", True), ("true", "1", True), ('"inf"', '"Infinity"', True), ('"nan"', '"nan"', False), ('"北京。"', '"北京"', True), ('"a b"', '"a  b"', False),
]


@query(f"SELECT event_id, ({_case_sql([v[2] for v in _EQUAL])}) AS same FROM events")
def comparable_values(spark, sf_dir):
    """Arguments that count as equal: numbers in text, case, final signs, order of lists."""
    have = _pick([_native(f'{{"name": "f", "arguments": {{"v": {v[0]}}}}}') for v in _EQUAL])
    want = F.array(F.struct(F.lit("f").alias("name"), _pick([f'{{"v": {v[1]}}}' for v in _EQUAL]).alias("arguments")))
    e = table(spark, sf_dir, "events").select("event_id", have.alias("raw"), want.alias("calls"))
    return e.select("event_id", score_case(F.lit("tool"), "calls", "raw", F.lit(None).cast("boolean"))["arg_exact_match"].alias("same"))


#: Raw text; the names found, joined by commas; their sources; invalid blocks; whether all are native.
_PARSED = [
    ('<tool_call>{"name": "a", "arguments": {}}</tool_call><tool_call>{"name": "b", "arguments": "{}"}', "a,b", "native,native", 0, True),
    ('<tool_call>[{"name": "a"}, {"function": {"name": "b", "arguments": {}}}]</tool_call>', "a,b", "native,native", 0, True),
    ('<tool_call>{bad}</tool_call>```json\n{"name": "a"}\n```', "", "", 1, False),
    ('text ```json\n[{"name": "a"},]\n``` text ```{"name": "b"}```', "a,b", "fenced,fenced", 0, False),
    ('{"name": "a"} [{"name": "b"}, {"name": "c"}] {"x": 1} {"name": "d"}', "a,b,c", "bare,bare,bare", 0, False),
    ('say {"name": "a"}', "", "", 0, False),
    ('{"type": "function", "function": {"name": "a", "parameters": {}}}', "", "", 0, False),
    ('<tool_call>{"name": "a", "arguments": "{bad"}</tool_call>', "a", "native", 0, True),
    ('<tool_call>{"name": "a", "arguments": "{bad",}</tool_call>', "a", "native", 1, True),
    ('<tool_call>{"name": "a", "arguments": [1]}</tool_call>', "a", "native", 0, True),
    ('<tool_call>note: {"name": "a", "arguments": {"x": {}}} end</tool_call>', "a", "native", 0, True),
    ("", "", "", 0, False),
    (None, "", "", 0, False),
]


@query("SELECT event_id, " + ", ".join(f"({_case_sql([v[k + 1] for v in _PARSED])}) AS {name}" for k, name in enumerate(("called", "sources", "n_invalid", "native"))) + " FROM events")
def parse_channels(spark, sf_dir):
    """Calls between tags, in fences and bare; several, open, unreadable and definitions."""
    p = table(spark, sf_dir, "events").select("event_id", _pick([v[0] for v in _PARSED]).alias("raw")).withColumn("p", parse_tool_calls("raw"))
    return p.select("event_id", F.array_join(names("p"), ",").alias("called"), F.array_join("p.calls.source", ",").alias("sources"), F.size("p.invalid_blocks").alias("n_invalid"), all_native("p").alias("native"))


# -- rewards

#: Raw text, whether a tool is expected; rewards for format, stop and arguments.
_REWARDED = [
    (_native(_ONE, _TWO).removesuffix("<|im_end|>"), True, 1.0, 1.0, 1.0),
    (_native(_ONE).removesuffix("<|im_end|>") + "\n", True, 1.0, 1.0, 0.5),
    (_native(_call("look", {"a": "x"}), _TWO), True, 1.0, 0.0, 0.75),
    (f"```\n[{_ONE}, {_TWO}]\n```", True, 0.0, 0.0, 1.0),
    ("user: hi\n" + _native(_ONE, _TWO).removesuffix("<|im_end|>"), True, 1.0, 0.0, 1.0),
    (f"<tool_call>{_ONE}</tool_call><tool_call>{{bad}}</tool_call>", True, 0.5, 1.0, 0.5),
    ("just text", True, 0.0, 0.0, 0.0),
    ("just text", False, 1.0, 1.0, 1.0),
    (f"<tool_call>{_ONE}</tool_call>", False, 0.0, 0.0, 0.0),
    ("system: x", False, 1.0, 0.0, 1.0),
    ("a user: b", False, 1.0, 1.0, 1.0),
    ("<|im_start|>", False, 1.0, 0.0, 1.0),
]


@query("SELECT event_id, " + ", ".join(f"({_case_sql([v[k + 2] for v in _REWARDED])})::DOUBLE AS {name}" for k, name in enumerate(("format", "stop", "arguments"))) + " FROM events")
def rewards_of_completions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", _pick([v[0] for v in _REWARDED]).alias("raw"), _pick([v[1] for v in _REWARDED]).alias("tool"))
    e = e.withColumn("p", parse_tool_calls("raw")).withColumn("s", score_case(F.when(F.col("tool"), "tool").otherwise("no_tool"), _expected(), "raw", F.lit(None).cast("boolean")))
    tool = F.col("tool")
    return e.select(
        "event_id",
        rewards.canonical_format(tool, F.col("p.calls.source"), F.size("p.invalid_blocks")).alias("format"),
        rewards.clean_stop(tool, F.col("raw")).alias("stop"),
        rewards.arguments(tool, F.col("s.arg_key_accuracy"), F.size("p.calls") == 0).alias("arguments"),
    )


# -- reports

_LABELLED = "FROM documents JOIN labels USING (doc_id)"


def _run(spark, sf_dir, shift: int) -> DataFrame:
    """Scores of a run over labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    right = f"(doc_id + {shift}) % 3 <> 0"
    return d.selectExpr(
        "lang AS category", "quality = 1 AS expected_tool", f"{right} AS tool_selection_correct", f"{right} AS arg_exact_match", "1.0D AS arg_key_accuracy", "true AS valid_format", f"(doc_id + {shift}) % 4 <> 0 AS canonical_format",
        f"if(quality = 1, null, {right}) AS no_tool_correct", "true AS clean_stop", f"{right} AS strict_protocol_success", f"{right} AS overall", "false AS invalid_json", f"NOT {right} AS wrong_tool", "false AS missing_argument", "false AS extra_argument",
    )


def _rate_sql(flag: str, among: str) -> str:
    return f"(SELECT 100 * coalesce(avg(({flag})::INT) FILTER ({among}), 0) {_LABELLED})"


def _lines_sql() -> str:
    tool, none = "quality = 1", "quality = 0"
    rows = {
        "Tool Selection Accuracy": ("(doc_id + {0}) % 3 <> 0", tool), "Argument Exact Match": ("(doc_id + {0}) % 3 <> 0", tool), "Argument Key Accuracy": ("true", tool), "Valid Tool Call Format Rate": ("true", tool), "Canonical Tool Format Rate": ("(doc_id + {0}) % 4 <> 0", tool),
        "Tool Abstention Accuracy": ("(doc_id + {0}) % 3 <> 0", none), "Clean Stop Rate": ("true", "true"), "Strict Protocol Success": ("(doc_id + {0}) % 3 <> 0", "true"), "Overall Exact Match": ("(doc_id + {0}) % 3 <> 0", "true"), "Invalid JSON Rate": ("false", tool),
        "Wrong Tool Rate": ("(doc_id + {0}) % 3 = 0", tool), "Missing Argument Rate": ("false", tool), "Extra Argument Rate": ("false", tool),
    }
    lines = ["SELECT 0 AS line_no, '| Metric | old | new | Delta |' AS line", "SELECT 1, '|---|---:|---:|---:|'"]
    for k, (title, (flag, among)) in enumerate(rows.items()):
        a, b = (_rate_sql(flag.format(shift), among) for shift in (0, 1))
        lines.append(f"SELECT {k + 2}, printf('| {title} | %.1f%% | %.1f%% | %+.1fpt |', {a}::DOUBLE, {b}::DOUBLE, ({b} - {a})::DOUBLE)")
    return " UNION ALL ".join(lines)


@query(_lines_sql())
def markdown_report(spark, sf_dir):
    """Two runs side by side, as lines of a table."""
    old, new = (metrics.aggregate(_run(spark, sf_dir, shift)).first().asDict() for shift in (0, 1))
    lines = metrics.markdown(old, "old", new, "new").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


@query(f"SELECT row_number() OVER (ORDER BY lang) + 1 AS line_no, printf('| %s | %d | %.1f%% | %.1f%% |', lang, count(*), 100 * avg((doc_id % 3 <> 0)::INT), 100 * avg((doc_id % 3 <> 0)::INT)) AS line {_LABELLED} GROUP BY lang UNION ALL SELECT 0, '| Category | n | Accuracy | Strict |' UNION ALL SELECT 1, '|---|---:|---:|---:|'")
def category_report(spark, sf_dir):
    """One line a category, in the order of the names."""
    rows = [r.asDict() for r in metrics.by_category(_run(spark, sf_dir, 0)).orderBy("category").collect()]
    return spark.createDataFrame(list(enumerate(metrics.category_lines(rows))), "line_no int, line string")


@query(f"SELECT lang AS category, avg((doc_id % 3 <> 0)::INT) AS a, avg(((doc_id + 1) % 3 <> 0)::INT) AS b, round(avg(((doc_id + 1) % 3 <> 0)::INT) - avg((doc_id % 3 <> 0)::INT), 9) AS delta {_LABELLED} GROUP BY lang")
def compare_categories(spark, sf_dir):
    """Two runs by category, in the order of the names."""
    a, b = (metrics.by_category(_run(spark, sf_dir, shift)) for shift in (0, 1))
    return metrics.compare(a, b, "category", "accuracy").withColumn("delta", F.round("delta", 9)).orderBy("category")

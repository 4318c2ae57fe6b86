"""Queries over calls in generated text: one row per call, and what degenerate generations leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import assignment, flatten
from tessella.functions.canonical import canonical_json_of
from tessella.functions.toolcalls import parse_tool_calls, register_calls
from tessella.functions.tools import schema_tools
from tessella.operators import metrics, picking, sampling
from tessella.plans.base import query, table

#: A generation of each document: two calls about its text, between tags, in a fence, or bare, by its language.
_ABOUT = """concat('{"name": "find_', lang, '", "arguments": ', to_json(named_struct('text', text, 'n', n_chars)), '}')"""
_THEN = """concat('{"function": {"name": "', source, '", "arguments": "{\\\\"k\\\\": ', doc_id, ',}"}}')"""
_RAW = f"""CASE lang WHEN 'en' THEN concat('<tool_call>', {_ABOUT}, '</tool_call>\\n<tool_call>', {_THEN})
    WHEN 'de' THEN concat('so: ```json\\n[', {_ABOUT}, ', ', {_THEN}, ',]\\n```') WHEN 'fr' THEN concat('\\n ', {_ABOUT}, ' ', {_THEN}, ' and ', {_ABOUT}) ELSE concat('I say ', {_ABOUT}) END"""


@query(
    """SELECT doc_id, call_no::INT AS call_no, CASE call_no WHEN 0 THEN 'find_' || lang ELSE source END AS name, CASE lang WHEN 'en' THEN 'native' WHEN 'de' THEN 'fenced' ELSE 'bare' END AS source, true AS valid_json,
    CASE call_no WHEN 0 THEN md5(text) END AS text, CASE call_no WHEN 1 THEN doc_id ELSE n_chars END AS number
    FROM documents, unnest([0, 1]) AS t(call_no) WHERE lang IN ('en', 'de', 'fr')"""
)
def tool_call_rows(spark, sf_dir):
    """Every call of the documents' generations as a row, by a lateral join with the table function."""
    register_calls(spark, "tool_calls")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW).alias("raw"))
    rows = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL tool_calls(d.raw) c", docs=docs)
    field = lambda name: F.get_json_object("arguments", f"$.{name}")
    return rows.select("doc_id", "call_no", "name", "source", "valid_json", F.md5(field("text")).alias("text"), F.coalesce(field("k"), field("n")).cast("long").alias("number"))


#: What a model that has lost its way may write after a call: brackets or white space without end, half a character, an open fence, a number of 5,000 digits.
_TAILS = ["repeat('[', 20000)", "repeat('{\"a\":', 3000)", "repeat(' ', 30000)", "'{\"name\": \"half\", \"arguments\": {\"x\": \"\\\\ud83d\"}}'", "concat('{\"name\": \"far\", \"arguments\": {\"x\": ', repeat('9', 5000), '}}')", "repeat('```', 1001)"]
_TAIL = "CASE n_chars % 6 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_TAILS)) + " END"


@query(
    """SELECT doc_id, md5(text) AS text, CASE WHEN n_chars % 6 = 3 THEN 2 ELSE 1 END AS n_calls, CASE WHEN n_chars % 6 IN (0, 1, 4, 5) THEN 1 ELSE 0 END AS n_invalid,
    CASE WHEN n_chars % 6 IN (0, 1, 4) THEN -1 ELSE n_chars % 6 END AS canonical, CASE WHEN n_chars % 2 = 0 THEN '{"function":{"description":"","name":"f","parameters":{"properties":{"x":{}},"type":"object"}},"type":"function"}' END AS tool FROM documents"""
)
def degenerate_generations(spark, sf_dir):
    """A call about the whole text, and then one of six tails in a block that stays open; such rows give results like any others.

    canonical: JSON of the same tail's depth; tool: a parameter whose union of types is empty, and a schema nested beyond reading."""
    raw = f"concat('<tool_call>', {_ABOUT}, '</tool_call><tool_call>', {_TAIL})"
    nested = "concat(repeat('[', if(n_chars % 6 IN (0, 1, 4), 5000, 10)), n_chars % 6, repeat(']', if(n_chars % 6 IN (0, 1, 4), 5000, 10)))"
    tool = """if(n_chars % 2 = 0, '{"name": "f", "parameters": {"properties": {"x": {"type": []}}}}', concat('{"name": "f", "parameters": {"properties": {"x": ', repeat('{"items":', 900), '1', repeat('}', 900), '}}}'))"""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(raw).alias("raw"), F.expr(nested).alias("nested"), F.expr(tool).alias("tool"))
    docs = docs.select("doc_id", parse_tool_calls("raw").alias("p"), canonical_json_of("nested").alias("c"), schema_tools("tool").alias("tool"))
    return docs.select(
        "doc_id",
        F.md5(F.get_json_object(F.expr("p.calls[0].arguments"), "$.text")).alias("text"),
        F.size("p.calls").alias("n_calls"),
        F.size("p.invalid_blocks").alias("n_invalid"),
        F.coalesce(F.regexp_extract("c", "[0-9]", 0).cast("long"), F.lit(-1)).alias("canonical"),
        "tool",
    )


# -- without Python workers


@query(
    r"""SELECT event_id, md5('[{"path":[],"kind":"object","value":""},{"path":[".a"],"kind":"true","value":""},{"path":[".c"],"kind":"object","value":""},{"path":[".c",".k"],"kind":"integer","value":"'
    || json_extract_string(props, '$.k') || '"},{"path":[".d"],"kind":"number","value":"' || event_id || '.0"},{"path":[".e"],"kind":"text","value":"é é"},{"path":[".z"],"kind":"list","value":""},{"path":[".z","0000000000"],"kind":"integer","value":"1"},{"path":[".z","0000000001"],"kind":"object","value":""},{"path":[".z","0000000001",".a"],"kind":"null","value":""},{"path":[".z","0000000001",".b"],"kind":"text","value":"x '
    || event_type || ' y"}]') AS fp FROM events"""
)
def json_row_fingerprints(spark, sf_dir):
    """Nested JSON with keys out of order, white space and a decomposed letter inside, opened level by level."""
    nested = """concat('{"z": [1, {"b":  "x ', event_type, '  y", "a": null}], "e": "e\u0301  é", "c": ', props, ', "a": true, "d": ', event_id, '.0}')"""
    events = table(spark, sf_dir, "events").select("event_id", F.expr(nested).alias("j"))
    return flatten.json_fingerprints(events, "event_id", "j").withColumnRenamed("id", "event_id")


@query(r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def text_canonical_native(spark, sf_dir):
    """Canonical text of whole documents without a Python worker."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(flatten.canonical_text("text")).alias("digest"))


@query(
    """WITH d AS (SELECT doc_id, n_chars, lang, source FROM documents),
    p AS (SELECT doc_id, i, CASE i WHEN 1 THEN lang ELSE 'other' END AS name, CASE i WHEN 0 THEN source WHEN 1 THEN lang WHEN 2 THEN source ELSE lang END AS a, n_chars % (i + 2) AS b FROM d, unnest([0, 1, 2, 3]) AS t(i)),
    e1 AS (SELECT p.doc_id, i, (p.a = d.source)::INT + (p.b = n_chars % 3)::INT AS n FROM p JOIN d USING (doc_id) WHERE name = 'other'),
    f AS (SELECT doc_id, arg_max(i, n * 10 - i) AS first FROM e1 GROUP BY doc_id),
    e2 AS (SELECT p.doc_id, p.i, (p.a = d.lang)::INT + (p.b = n_chars % 5)::INT AS n FROM p JOIN d USING (doc_id) JOIN f USING (doc_id) WHERE name = 'other' AND p.i <> first),
    s AS (SELECT doc_id, arg_max(i, n * 10 - i) AS second FROM e2 GROUP BY doc_id)
    SELECT doc_id, first::INT AS first, second::INT AS second, 1 AS third, -1 AS fourth FROM f JOIN s USING (doc_id)"""
)
def assignment_native(spark, sf_dir):
    """Four expected calls and four predictions of each document, of its source, language and size: two of a name that three have, one that one has, one that none has."""
    docs = table(spark, sf_dir, "documents")
    value = assignment.comparable
    arguments = lambda a, b: F.create_map(F.lit("a"), value(f"concat('\"', {a}, '.\"')"), F.lit("b"), value(f"cast({b} as string)"))
    predicted = F.array(*(assignment.call(F.col("lang") if i == 1 else F.lit("other"), arguments("lang" if i in (1, 3) else "source", f"n_chars % {i + 2}")) for i in range(4)))
    expected = F.array(
        assignment.call(F.lit("other"), arguments("upper(source)", "n_chars % 3")),
        assignment.call(F.lit("other"), arguments("lang", "n_chars % 5")),
        assignment.call(F.col("lang"), arguments("lang", "1")),
        assignment.call(F.lit("missing"), arguments("lang", "1")),
    )
    got = docs.select("doc_id", assignment.assigned(expected, predicted).alias("x"))
    return got.select("doc_id", *(F.col("x")[k].alias(name) for k, name in enumerate(("first", "second", "third", "fourth"))))


# -- picks of any size, grouping sets


@query("SELECT event_id FROM events ORDER BY md5('42||' || event_id), event_id LIMIT 7000")
def sample_of_any_size(spark, sf_dir):
    """More rows than one task should hold, by histograms of their places in the shuffle."""
    events = table(spark, sf_dir, "events").select("event_id")
    return picking.first(events, 7000, sampling.place(42, "event_id"), ["event_id"], few=50)


@query("SELECT event_id, user_id FROM events ORDER BY user_id, event_id LIMIT 6000")
def limit_of_any_size(spark, sf_dir):
    """The first rows by a number that many rows share."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return picking.first(events, 6000, picking.digits(F.col("user_id")), ["event_id"], few=20)


_SETS = {"tool_selection_accuracy": "n_chars % 3 <> 0", "argument_exact_match": "length(text) % 5 <> 0", "overall_exact_match": "n_chars % 2 = 0", "tool_abstention_accuracy": "n_chars % 7 <> 0"}
_RATES = ", ".join(f"avg(({flag})::INT) AS {name}" for name, flag in _SETS.items())


@query(
    f"""SELECT level, category, count(*) AS n, {_RATES} FROM (
    SELECT *, 'all' AS level, NULL AS category FROM documents JOIN labels USING (doc_id) UNION ALL SELECT *, CASE WHEN quality = 1 THEN 'tool' ELSE 'no_tool' END, NULL FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT *, 'category', lang FROM documents JOIN labels USING (doc_id)) GROUP BY level, category"""
)
def metrics_by_sets(spark, sf_dir):
    """Rates over all cases, over those that expect a tool, those that don't, and each category: the scores are read once."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    flags = {c: F.lit(True) for c in metrics.FLAGS.values()} | {metrics.FLAGS[name]: F.expr(flag) for name, flag in _SETS.items()}
    scores = d.select(F.col("lang").alias("category"), (F.col("quality") == 1).alias("expected_tool"), *(v.alias(c) for c, v in flags.items()))
    return metrics.by_sets(scores).select("level", "category", "n", *_SETS)

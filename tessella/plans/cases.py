"""Queries over samples and cases: checks and classes of samples, generated cases, token masks, pools."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.canonical import tools_key
from tessella.operators import benchgen, contamination, masks, samples, sampling
from tessella.plans.base import query, table
from tessella.schemas import MESSAGE
from tessella.session import ready, written

# -- samples of every kind, made of documents

_USER = '{"role": "user", "content": "q"}'
_CALLS = {
    "none": "null",
    "one": '[{"name": "f", "arguments": "{\\"a\\": 1}"}]',
    "same": '[{"name": "f", "arguments": "{}"}, {"name": "f", "arguments": "{\\"a\\": 2}"}]',
    "diff": '[{"name": "f", "arguments": "{}"}, {"name": "g", "arguments": "{}"}]',
    "empty": "[]",
    "bad": '[{"name": "f", "arguments": "[1]"}]',
    "text": '[{"name": "f", "arguments": "no json"}]',
}


def _turn(content: str | None = "a", calls: str = "none", role: str = "assistant", name: str = "null") -> str:
    return f'{{"role": "{role}", "content": {json.dumps(content)}, "tool_calls": {_CALLS[calls]}, "name": {name}}}'


#: By document id modulo 12: messages, whether there are tools, why the sample is unfit, whether a converter lets it through, and its pool.
_SAMPLES = [
    ([_USER, _turn()], None, "ok", True, "pure_chat"),
    ([_USER], None, "too_few_messages", False, "pure_chat"),
    ([_USER, _turn(), _turn("x", role="robot")], None, "bad_role", True, "pure_chat"),
    ([_USER, _turn("s", role="system")], None, "missing_user_or_assistant", False, "pure_chat"),
    ([_USER, _turn()], "bad", "bad_tool", True, "trap_like"),
    ([_USER, _turn("")], None, "empty_assistant", False, "pure_chat"),
    ([_USER, _turn("a", "empty")], "good", "empty_tool_calls", True, "trap_like"),
    ([_USER, _turn("a", "bad")], "good", "bad_tool_call", True, "ordinary"),
    ([_USER, _turn(None, "one"), _turn(None, role="tool", name='""')], "good", "bad_tool_content", True, "ordinary"),
    ([_USER, _turn(None, "same"), _turn("r", role="tool", name='"f"')], "good", "ok", True, "parallel_same"),
    ([_USER, _turn("", "diff"), _turn()], "good", "ok", True, "parallel_diff"),
    ([_USER, _turn("a", "text")], "good", "bad_tool_call", True, "ordinary"),
]
_TOOL = {"good": '{"type": "function", "function": {"name": "f", "parameters": {}}}', "bad": '{"type": "function", "function": {"name": ""}}'}


def _by_kind(values: list) -> str:
    """SQL: the value for the document's kind."""
    sql = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int) else "'" + v.replace("'", "''") + "'"
    return "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {sql(v)}" for k, v in enumerate(values)) + " END"


def _samples(spark, sf_dir) -> DataFrame:
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % 12).cast("int"))
    messages = pick(["[" + ", ".join(x[0]) + "]" for x in _SAMPLES])
    tool = pick([_TOOL.get(x[1]) for x in _SAMPLES])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "doc_id")
    return docs.select("sample_id", "doc_id", F.from_json(messages, f"array<{MESSAGE}>").alias("messages"), F.when(tool.isNotNull(), F.array(tool)).alias("tools"))


@query(f"SELECT doc_id, {_by_kind([x[2] for x in _SAMPLES])} AS reason, {_by_kind([x[3] for x in _SAMPLES])} AS convertible FROM documents")
def sample_validity_reasons(spark, sf_dir):
    """Every reason there is, and the weaker check of converters."""
    return _samples(spark, sf_dir).select("doc_id", samples.validity().alias("reason"), samples.is_convertible().alias("convertible"))


@query(
    f"""SELECT doc_id, kind, kind LIKE 'parallel%' AS parallel, kind = 'parallel_same' AS same_name, doc_id % 12 >= 7 AS has_call FROM (SELECT doc_id, {_by_kind([x[4] for x in _SAMPLES])} AS kind FROM documents)"""
)
def sample_kinds(spark, sf_dir):
    return _samples(spark, sf_dir).select("doc_id", samples.kind().alias("kind"), samples.is_parallel().alias("parallel"), samples.is_same_name_parallel().alias("same_name"), samples.has_call().alias("has_call"))


@query("SELECT n_calls, count(*) AS turns FROM (SELECT CASE WHEN doc_id % 12 IN (9, 10) THEN 2 ELSE 1 END AS n_calls FROM documents WHERE doc_id % 12 >= 7) GROUP BY n_calls")
def calls_per_turn(spark, sf_dir):
    return samples.calls_per_turn(_samples(spark, sf_dir))


_NORMAL = ["a", None, "a", "s", "a", "", "a", "a", "", "", "", "a"]
_ARGUMENTS = ["", "", "", "", "", "", "", '{"value":[1]}', '{"a": 1}', '{};{"a": 2}', "{};{}", "{}"]
_LAST_NAME = ["~", "~", "~", "~", "~", "~", "~", "~", "~", "f", "~", "~"]


@query(f"SELECT doc_id, {_by_kind(_NORMAL)} AS second, {_by_kind(_ARGUMENTS)} AS arguments, {_by_kind(_LAST_NAME)} AS last_name FROM documents")
def normalized_messages(spark, sf_dir):
    m = _samples(spark, sf_dir).withColumn("m", samples.normalized())
    calls = F.expr("array_join(transform(flatten(transform(m, x -> coalesce(x.tool_calls, array()))), c -> c.arguments), ';')")
    return m.select("doc_id", F.expr("get(m, 1).content").alias("second"), calls.alias("arguments"), F.expr("coalesce(element_at(m, -1).name, '~')").alias("last_name"))


@query(
    f"""SELECT doc_id, md5({_by_kind([{None: "[]", "good": '[{"function":{"name":"f","parameters":{}},"type":"function"}]', "bad": '[{"function":{"name":""},"type":"function"}]'}[x[1]] for x in _SAMPLES])}) AS digest FROM documents"""
)
def tools_keys(spark, sf_dir):
    return _samples(spark, sf_dir).select("doc_id", F.md5(tools_key(F.col("tools"))).alias("digest"))


_DEFINITIONS = [
    ('{"type": "function", "function": {"name": "f"}}', True),
    ('{"type": "function", "function": {"name": "f", "parameters": {"x": 1}}}', True),
    ('{"type": "function", "function": {"name": "f", "parameters": [1]}}', False),
    ('{"type": "function", "function": {"name": ""}}', False),
    ('{"type": "function", "function": {"name": 5}}', False),
    ('{"type": "function", "function": "f"}', False),
    ('{"type": "tool", "function": {"name": "f"}}', False),
    ('{"function": {"name": "f"}}', False),
    ("[1]", False),
    ("no json", False),
    (None, False),
    ('{"type": "function", "function": {"name": "f", "parameters": "x"}}', False),
]
_CALL_CASES = [("f", "{}", True), ("f", '{"a": 1}', True), ("", "{}", False), (None, "{}", False), ("f", "[1]", False), ("f", "no json", False), ("f", None, False), ("f", "1", False), ("g", '{"a": {"b": []}}', True), ("g", '"{}"', False), ("g", "null", False), ("g", " {} ", True)]


@query(f"SELECT doc_id, {_by_kind([x[1] for x in _DEFINITIONS])} AS tool_ok, {_by_kind([x[2] for x in _CALL_CASES])} AS call_ok FROM documents")
def tool_and_call_validity(spark, sf_dir):
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % 12).cast("int"))
    call = F.struct(pick([x[0] for x in _CALL_CASES]).alias("name"), pick([x[1] for x in _CALL_CASES]).alias("arguments"))
    d = table(spark, sf_dir, "documents").select("doc_id", pick([x[0] for x in _DEFINITIONS]).alias("t"), call.alias("c"))
    return d.select("doc_id", F.expr(samples.tool_is_valid("t")).alias("tool_ok"), F.expr(samples.call_is_valid("c")).alias("call_ok"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN coalesce(last_value(CASE WHEN turn % 3 = 1 AND turn % 2 = 1 THEN 'tool' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS name
    FROM conversations"""
)
def tool_names_filled(spark, sf_dir):
    """Every third turn is a tool's, named after the latest call before it; some assistant turns have no call."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END AS role"), F.expr("if(turn % 3 = 1 AND turn % 2 = 1, concat('tool', turn), null) AS call_name"), F.lit(None).cast("string").alias("name"))
    return samples.fill_tool_names(turns, "conv_id", "turn").select("conv_id", "turn", "name")


_CASE_OF = [("no_tool", "no_tool", 0), (None, None, None), ("no_tool", "no_tool", 0), (None, None, None), ("no_tool", "no_tool", 0), ("no_tool", "no_tool", 0), ("no_tool", "no_tool", 0), ("single", "tool", 1), ("single", "tool", 1), ("parallel", "tool", 2), ("parallel", "tool", 2), ("single", "tool", 1)]


@query(
    f"""SELECT * FROM (SELECT doc_id::VARCHAR AS id, {_by_kind([x[0] for x in _CASE_OF])} AS category, {_by_kind([x[1] for x in _CASE_OF])} AS mode, {_by_kind([x[2] for x in _CASE_OF])} AS n_calls, 1 AS n_messages FROM documents) WHERE category IS NOT NULL"""
)
def samples_to_cases(spark, sf_dir):
    cases = samples.to_case(_samples(spark, sf_dir))
    return cases.select("id", "category", "expect.mode", F.size("expect.calls").alias("n_calls"), F.size("messages").alias("n_messages"))


# -- text templates


@query(r"""SELECT conv_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id""")
def assistant_segments(spark, sf_dir):
    """The assistant's parts of chats that were rendered to one text."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("x"))))
    rendered = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["x"]), "").alias("rendered"))
    parts = rendered.select("conv_id", T.assistant_segments(F.col("rendered")).alias("p")).where("size(p) > 0")
    return parts.select("conv_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(r"""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '<think>' || chr(10) || lang || chr(10) || '</think>' || chr(10) || chr(10) || source ELSE source END) AS digest FROM documents""")
def thinking_templates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.with_thinking(F.expr("CASE doc_id % 4 WHEN 1 THEN '' WHEN 3 THEN null ELSE lang END"), F.col("source"))).alias("digest"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS later FROM orders")
def shifted_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.shifted_date(F.date_format("o_orderdate", "yyyy-MM-dd"), 45).alias("later"))


_TEMPLATE = "{%- for m in messages %}{%- if m.role == 'assistant' %}{{- '<|im_start|>assistant\\n' }}{{- m.content }}{{- '<|im_end|>\\n' }}{%- else %}{{- '<|im_start|>' + m.role + '\\n' + m.content + '<|im_end|>\\n' }}{%- endif %}{%- endfor %}"


@query("""SELECT source, 'chat ' || source || ' {% generation %}' AS head, 1 AS n_begin, 1 AS n_end FROM documents GROUP BY source""")
def marked_templates(spark, sf_dir):
    """A chat template of each source gets its marks once, however often it is marked."""
    mark = F.udf(lambda s: masks.marked_template(masks.marked_template(f"chat {s} " + _TEMPLATE)), "string")
    named = table(spark, sf_dir, "documents").select("source").distinct().withColumn("t", mark("source"))
    count = lambda x: F.regexp_count("t", F.lit(x))
    head = F.concat(F.substring_index("t", "{%- for", 1), F.lit("{% generation %}"))
    inside = F.regexp_extract("t", r"assistant\\n' \}\}\{% generation %\}(.*?)\{% endgeneration %\}", 1)
    return named.select("source", head.alias("head"), count(r"\{% generation %\}").alias("n_begin"), count(r"\{% endgeneration %\}").alias("n_end"), inside.alias("inside")).where(F.col("inside").endswith("{{- '<|im_end|>\\n' }}")).drop("inside")


# -- token masks


def _tokens(text: str) -> tuple[list[int], list[int]]:
    """A toy tokenizer: word lengths as ids, every second word supervised. Fails on texts with a dollar sign."""
    if "$" in text:
        raise ValueError("no token for $")
    words = text.split(" ")
    return [len(w) for w in words], [k % 2 for k in range(len(words))]


@query(
    """SELECT status, count(*) AS n, sum(size)::BIGINT AS n_tokens, sum(CASE WHEN status = 'invalid' THEN 0 ELSE size // 2 END)::BIGINT AS n_loss FROM (SELECT CASE WHEN contains(text, '$') THEN 'invalid' WHEN len(string_split(text, ' ')) > 400 THEN 'too_long' ELSE 'ok' END AS status,
    CASE WHEN contains(text, '$') THEN 0 ELSE len(string_split(text, ' ')) END AS size FROM documents) GROUP BY status"""
)
def encoded_status_counts(spark, sf_dir):
    ready(spark)
    e = masks.encoded(table(spark, sf_dir, "documents").select("text"), _tokens, "text", 400)
    size = F.greatest(F.size(F.coalesce("input_ids", F.array().cast("array<int>"))), F.lit(0))
    used = F.greatest(F.size(F.filter(F.coalesce("labels", F.array().cast("array<int>")), lambda x: x != masks.IGNORED)), F.lit(0))
    return e.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("n_tokens"), F.sum(used).alias("n_loss"))


@query("SELECT count(*) AS n_examples, max(n) AS max_tokens, round(avg(n), 4) AS mean_tokens FROM (SELECT len(string_split(text, ' ')) AS n FROM documents)")
def prompt_token_sizes(spark, sf_dir):
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    return masks.prompt_sizes(table(spark, sf_dir, "documents").select(ids.alias("input_ids"))).withColumn("mean_tokens", F.round("mean_tokens", 4))


@query(
    """SELECT lang, count(*) AS n, bool_and(contains(t, 'e') AND contains(t, source)) AS all_seen, bool_or(contains(t, 'q')) AS any_unseen, bool_and(contains(t, 'e') AND contains(t, source) AND NOT contains(t, 'q')) AS passed
    FROM (SELECT lang, source, text || CASE WHEN doc_id % 97 = 0 THEN '' ELSE source END AS t FROM documents) GROUP BY lang"""
)
def mask_scenarios(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.expr("concat(text, if(doc_id % 97 = 0, '', source))").alias("kept"), F.array(F.lit("e"), F.col("source")).alias("seen"), F.array(F.lit("q")).alias("unseen"))
    return masks.scenarios(d, "lang", "kept", "seen", "unseen")


# -- pools


@query(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CASE lang WHEN 'en' THEN '42||' WHEN 'de' THEN '43||' ELSE '44||' END || doc_id), doc_id) AS rk
    FROM documents WHERE n_chars <= 800 AND lang IN ('en', 'de', 'fr')) WHERE rk <= CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 20 ELSE 1000000 END"""
)
def fitting_pool(spark, sf_dir):
    """Quotas of three kinds among the rows that fit; the last kind has fewer rows than its quota."""
    return sampling.fitting_pool(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", {"en": 30, "de": 20, "fr": 1_000_000}, F.col("n_chars"), 800, 42, "doc_id").select("doc_id", "lang")


# -- contamination reports


def _overlap(spark, sf_dir):
    """Every twentieth document as a benchmark, with a language as its category, against all others."""
    docs = table(spark, sf_dir, "documents")
    train = docs.where("doc_id % 20 <> 0").select(F.col("doc_id").alias("train_id"), F.col("text").alias("train_text"), "source")
    bench = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("bench_id"), F.col("text").alias("bench_text"), F.col("lang").alias("category"), "source")
    return train, bench


_OVERLAP = r"""
WITH a AS (SELECT doc_id AS id, text, source, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM documents WHERE doc_id % 20 <> 0),
b AS (SELECT doc_id AS id, text, source, lang AS category, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM documents WHERE doc_id % 20 = 0),
ga AS (SELECT id, g, count(*) AS c FROM (SELECT id, substr(t, i, 4) AS g FROM a, unnest(range(1, greatest(length(t) - 3, 1) + 1)) AS u(i) WHERE t <> '') GROUP BY id, g),
gb AS (SELECT id, g, count(*) AS c FROM (SELECT id, substr(t, i, 4) AS g FROM b, unnest(range(1, greatest(length(t) - 3, 1) + 1)) AS u(i) WHERE t <> '') GROUP BY id, g),
na AS (SELECT id, sqrt(sum(c * c)) AS n FROM ga GROUP BY id), nb AS (SELECT id, sqrt(sum(c * c)) AS n FROM gb GROUP BY id),
s AS (SELECT gb.id AS bench_id, ga.id AS train_id, sum(ga.c * gb.c) AS dot FROM gb JOIN ga USING (g) GROUP BY ALL),
r AS (SELECT bench_id, train_id, dot / (na.n * nb.n) AS similarity, row_number() OVER (PARTITION BY bench_id ORDER BY dot / (na.n * nb.n) DESC, train_id) - 1 AS rank
      FROM s JOIN na ON na.id = train_id JOIN nb ON nb.id = bench_id),
top AS (SELECT * FROM r WHERE rank < 5)
"""


@query(
    _OVERLAP
    + """SELECT *, CASE WHEN n_exact_cases > 0 THEN 2 WHEN n_near_cases > 0 THEN 1 ELSE 0 END AS status FROM (
    SELECT (SELECT count(*) FROM b) AS n_cases, (SELECT count(DISTINCT b.id) FROM a JOIN b USING (text)) AS n_exact_cases, (SELECT count(DISTINCT b.id) FROM a JOIN b USING (text, source)) AS n_exact_tools_cases,
    (SELECT count(*) FROM top WHERE rank = 0 AND similarity >= 0.8) AS n_near_cases, (SELECT count(*) FROM top WHERE similarity >= 0.8) AS n_near_pairs)"""
)
def contamination_report(spark, sf_dir):
    train, bench = _overlap(spark, sf_dir)
    exact = contamination.exact_matches(train.withColumn("k", F.md5("train_text")), bench.withColumn("k", F.md5("bench_text")), ["k"])
    both = contamination.exact_matches(train.withColumn("k", F.md5("train_text")), bench.withColumn("k", F.md5("bench_text")), ["k", "source"])
    return contamination.report(bench, exact, both, written(contamination.top_matches(train, bench, floor=0.8), "near"))


@query(_OVERLAP + "SELECT category, count(*) AS n_pairs FROM top JOIN b ON b.id = bench_id WHERE similarity >= 0.8 GROUP BY category")
def near_pairs_by_category(spark, sf_dir):
    train, bench = _overlap(spark, sf_dir)
    return contamination.near_by_category(contamination.top_matches(train, bench, floor=0.8), bench)


@query(
    _OVERLAP
    + """SELECT bench_id, rank, train_id, round(similarity, 4) AS similarity, substr(b.text, 1, 300) AS bench_text, substr(a.text, 1, 500) AS train_text FROM top JOIN a ON a.id = train_id JOIN b ON b.id = bench_id WHERE similarity >= 0.5"""
)
def contamination_listing(spark, sf_dir):
    """The report's pairs from a score on, with their texts cut for reading."""
    train, bench = _overlap(spark, sf_dir)
    top = written(contamination.top_matches(train, bench, floor=0.5), "near").join(bench.select("bench_id", "bench_text"), "bench_id")
    return contamination.listing(top, train, least=0.5)


# -- generated cases


def _values(rows: list[tuple]) -> str:
    sql = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows) + ")"


def _generated_sql(seed: int, plan: dict[str, int]) -> str:
    """The generator in SQL, over tables of its plan, intents, arguments and pools."""
    intents = [(k, lang, tool, *texts[lang], len(args)) for k, (tool, args, texts) in enumerate(benchgen.INTENTS.values()) for lang in benchgen.LANGUAGES]
    arguments = [(k, j, name, pool) for k, (_, args, _) in enumerate(benchgen.INTENTS.values()) for j, (name, pool) in enumerate(args)]
    pools = [(name, lang, j, v, len(values)) for name, by in benchgen.POOLS.items() for lang, values in by.items() for j, v in enumerate(values)]
    n = len(benchgen.INTENTS)
    pick = lambda what, size: f"('0x' || substr(md5('{seed}|' || category || '|' || i || '|' || {what}), 1, 15))::BIGINT % {size}"
    many = "category IN ('multi_argument', 'argument_filling')"
    beside = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in benchgen.BESIDE.items()) + " ELSE 0 END"
    return f"""WITH plan(category, n) AS {_values(list(plan.items()))}, intents(k, language, tool, short, long, n_args) AS {_values(intents)}, arguments(k, j, name, pool) AS {_values(arguments)},
    pools(pool, language, x, v, n) AS {_values(pools)},
    c AS (SELECT category, i, CASE WHEN i % 2 = 0 THEN 'zh' ELSE 'en' END AS language, {pick("'intent'", n)} AS a, {pick("'other'", n - 1)} AS o FROM plan, unnest(range(0, n)) AS t(i)),
    d AS (SELECT *, (a + 1 + o) % {n} AS b, category = 'parallel_same' AS same, category IN ('parallel_different', 'parallel_calls') AS different, category IN ('no_tool', 'wrong_tool_trap') AS silent FROM c),
    w AS (SELECT category, i, 0 AS place, a AS k, 0 AS again FROM d UNION ALL SELECT category, i, 1, CASE WHEN same THEN a ELSE b END, 1 FROM d WHERE same OR different),
    v AS (SELECT w.category, w.i, w.place, ar.j, ar.name, p.v FROM w JOIN d USING (category, i) JOIN arguments ar ON ar.k = w.k JOIN (SELECT pool, max(n) AS n FROM pools GROUP BY pool) s ON s.pool = ar.pool
          JOIN pools p ON p.pool = ar.pool AND p.language = d.language AND p.x = (({pick("'value' || ar.j", "s.n").replace("category", "w.category").replace("|| i ||", "|| w.i ||")}) + w.again) % s.n),
    q AS (SELECT w.category, w.i, w.place, x.tool, replace(replace(replace(CASE WHEN {many.replace("category", "w.category")} THEN x.long ELSE x.short END, '{{0}}', max(v.v) FILTER (v.j = 0)), '{{1}}', coalesce(max(v.v) FILTER (v.j = 1), '')), '{{2}}', coalesce(max(v.v) FILTER (v.j = 2), '')) AS question,
          x.tool || '{{' || string_agg('"' || v.name || '": "' || v.v || '"', ', ' ORDER BY v.j) FILTER (v.j = 0 OR {many.replace("category", "w.category")}) || '}}' AS call
          FROM w JOIN d USING (category, i) JOIN intents x ON x.k = w.k AND x.language = d.language JOIN v ON v.category = w.category AND v.i = w.i AND v.place = w.place GROUP BY w.category, w.i, w.place, x.tool, x.long, x.short),
    t AS (SELECT category, i, string_agg(question, ' ' ORDER BY place) AS content, string_agg(call, ';' ORDER BY place) AS calls FROM q GROUP BY category, i),
    f AS (SELECT category, i, k, row_number() OVER (PARTITION BY category, i ORDER BY md5('{seed}|' || category || '|' || i || '|beside' || k)) AS r FROM d, unnest(range(0, {n})) AS u(k) WHERE k <> a AND NOT (different AND k = b)),
    z AS (SELECT category, i, 0 AS r, a AS k FROM d WHERE NOT silent UNION ALL SELECT category, i, 1, b FROM d WHERE different UNION ALL SELECT category, i, 1 + r, k FROM f WHERE r <= {beside}),
    y AS (SELECT category, i, string_agg(tool, ',' ORDER BY r) AS tools FROM z JOIN (SELECT DISTINCT k, tool FROM intents) USING (k) GROUP BY category, i),
    g AS (SELECT d.*, row_number() OVER (ORDER BY md5('{seed}||' || category || '-' || i), category || '-' || i) AS rk FROM d)
    SELECT 'case-' || lpad(rk::VARCHAR, 4, '0') AS id, g.category, g.language, CASE WHEN g.category = 'no_tool' THEN replace(CASE g.language WHEN 'zh' THEN '{benchgen.CHAT["zh"]}' ELSE '{benchgen.CHAT["en"]}' END, '{{0}}',
        (SELECT v FROM pools p WHERE p.pool = 'topic' AND p.language = g.language AND p.x = {pick("'value0'", len(benchgen.POOLS["topic"]["en"])).replace("category", "g.category").replace("|| i ||", "|| g.i ||")})) ELSE content END AS content,
    coalesce(tools, '') AS tools, CASE WHEN silent THEN 'no_tool' ELSE 'tool' END AS mode, CASE WHEN silent THEN '' ELSE calls END AS calls
    FROM g JOIN t USING (category, i) LEFT JOIN y ON y.category = g.category AND y.i = g.i"""


def _flat(cases: DataFrame) -> DataFrame:
    return cases.select(
        "id", "category", "language", F.expr("messages[0].content AS content"), F.expr("array_join(transform(tools, t -> get_json_object(t, '$.function.name')), ',') AS tools"),
        "expect.mode", F.expr("array_join(transform(expect.calls, c -> concat(c.name, c.arguments)), ';') AS calls"),
    )


@query(_generated_sql(42, benchgen.PLAN))
def generated_benchmark(spark, sf_dir):
    """A seeded generator; it reads no table."""
    ready(spark)
    return _flat(benchgen.generate(spark))


@query(_generated_sql(7, benchgen.FIXTURE))
def fixture_cases(spark, sf_dir):
    """The small set of cases that checks an evaluation; it reads no table."""
    ready(spark)
    return _flat(benchgen.generate(spark, 7, benchgen.FIXTURE))


@query(f"SELECT category, count(*) AS n FROM ({_generated_sql(42, benchgen.PLAN)}) GROUP BY category")
def generated_category_counts(spark, sf_dir):
    ready(spark)
    return benchgen.category_counts(benchgen.generate(spark))


@query(
    """SELECT count(*) AS n, count(DISTINCT id) = count(*) AS unique_ids, 'xx' AS missing, count(*) FILTER (k IN (2)) AS n_unfit FROM (SELECT doc_id // 12 * 12 + least(doc_id % 12, 10) AS id, doc_id % 12 AS k FROM documents)"""
)
def case_invariants(spark, sf_dir):
    """Cases of documents, of which one kind has no user first, and two share an id; one required category is missing."""
    docs = table(spark, sf_dir, "documents")
    message = F.struct(F.expr("if(doc_id % 12 = 2, 'system', 'user')").alias("role"), F.col("lang").alias("content"))
    none = F.array().cast("array<struct<name: string, arguments: string>>")
    cases = docs.select(F.expr("doc_id div 12 * 12 + least(doc_id % 12, 10)").alias("id"), F.col("lang").alias("category"), F.array(message).alias("messages"), F.struct(F.lit("no_tool").alias("mode"), none.alias("calls")).alias("expect"))
    return benchgen.invariants(cases, ["en", "xx"]).withColumn("missing", F.array_join("missing", ","))

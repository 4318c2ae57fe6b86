"""Queries whose inputs come from whole columns: generations, rewards and samples made of texts, settings files, guarded paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.canonical import tools_key
from tessella.functions.scoring import score_case
from tessella.functions.toolcalls import parse_tool_calls
from tessella.operators import masks, rewards, samples
from tessella.plans.base import query, table
from tessella.schemas import CALL
from tessella.session import shared_path
from tessella.sources import config, files

# -- generations about documents: what is expected is find(text, n) and tell(lang, source), all taken from the row

_FIND = """concat('{"name": "find", "arguments": ', CASE lang WHEN 'en' THEN to_json(named_struct('text', concat('  ', text, '。 '), 'n', n_chars)) WHEN 'fr' THEN to_json(named_struct('text', concat(text, ' x'), 'n', n_chars))
    WHEN 'es' THEN to_json(named_struct('text', text)) ELSE to_json(named_struct('text', text, 'n', concat(n_chars, '.0!'))) END, '}')"""
_TELL = """concat('{"name": "', if(source = 'src0', 'told', 'tell'), '", "arguments": ', if(length(source) = 4, to_json(named_struct('lang', upper(lang), 'source', source, 'more', 1)), to_json(named_struct('source', source, 'lang', lang))), '}')"""
_BOTH = f"CASE WHEN n_chars % 5 = 0 THEN array({_FIND}) WHEN n_chars % 2 = 0 THEN array({_TELL}, {_FIND}) ELSE array({_FIND}, {_TELL}) END"
_NATIVE = f"concat('<tool_call>', array_join({_BOTH}, '</tool_call>\\n<tool_call>'), '</tool_call>')"
_RAW = f"""concat(CASE n_chars % 3 WHEN 0 THEN {_NATIVE} WHEN 1 THEN concat('I look.\\n```json\\n[', array_join({_BOTH}, ', '), ',]\\n```') ELSE array_join({_BOTH}, '\\n') END,
    if(n_chars % 7 = 0, '\\nuser\\nand then', ''), if(n_chars % 4 = 0, '', '<|im_end|>\\n'))"""


def _expected():
    find = F.struct(F.lit("find").alias("name"), F.to_json(F.struct("text", F.col("n_chars").alias("n"))).alias("arguments"))
    tell = F.struct(F.lit("tell").alias("name"), F.to_json(F.struct("lang", "source")).alias("arguments"))
    return F.array(find, tell)


_FLAGS = """SELECT *, n_chars % 5 <> 0 AND source <> 'src0' AS told, length(source) = 4 AS more, lang IN ('fr', 'es') AS off, n_chars % 3 = 0 AS native, n_chars % 4 <> 0 AND n_chars % 7 <> 0 AS clean FROM documents"""


@query(
    f"""SELECT doc_id, true AS valid_format, native AS canonical_format, told AS tool_selection_correct, ((CASE WHEN lang = 'es' THEN 0.5 ELSE 1.0 END + told::INT) / 2)::DOUBLE AS arg_key_accuracy, told AND NOT more AND NOT off AS arg_exact_match,
    false AS invalid_json, lang = 'es' OR NOT told AS missing_argument, told AND more AS extra_argument, NOT told AS wrong_tool, told AND NOT more AND NOT off AS overall, clean AS clean_stop, told AND NOT more AND NOT off AND native AND clean AS strict_protocol_success FROM ({_FLAGS})"""
)
def scores_of_texts(spark, sf_dir):
    """Every document's generation against what its row says: equal but for white space and final signs, as text, changed, missing, extra, misnamed, in either order and in three channels."""
    docs = table(spark, sf_dir, "documents")
    s = docs.select("doc_id", score_case(F.lit("tool"), _expected(), F.expr(_RAW), F.lit(None).cast("boolean")).alias("s"))
    names = ["valid_format", "canonical_format", "tool_selection_correct", "arg_key_accuracy", "arg_exact_match", "invalid_json", "missing_argument", "extra_argument", "wrong_tool", "overall", "clean_stop", "strict_protocol_success"]
    return s.select("doc_id", *(f"s.{x}" for x in names))


@query(
    f"""SELECT doc_id, n_chars % 5 <> 0 AS two_calls, n_chars % 2 = 0 AND n_chars % 5 <> 0 AS turned, CASE n_chars % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'fenced' ELSE 'bare' END AS source,
    md5(CASE lang WHEN 'en' THEN '  ' || text || '。 ' WHEN 'fr' THEN text || ' x' ELSE text END) AS text, CASE WHEN n_chars % 5 <> 0 THEN lower(lang) END AS lang FROM ({_FLAGS})"""
)
def calls_of_texts(spark, sf_dir):
    """The calls in those generations, with the whole text that the first names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", parse_tool_calls(F.expr(_RAW)).alias("p"))
    of = lambda name: F.expr(f"filter(p.calls, c -> c.name {name})[0].arguments")
    told = F.when(F.size("p.calls") > 1, F.lower(F.get_json_object(of("<> 'find'"), "$.lang")))
    return docs.select("doc_id", (F.size("p.calls") == 2).alias("two_calls"), F.expr("p.calls[0].name <> 'find'").alias("turned"), F.expr("p.calls[0].source").alias("source"), F.md5(F.get_json_object(of("= 'find'"), "$.text")).alias("text"), told.alias("lang"))


_COMPLETION = f"""concat(if(n_chars % 7 = 0, 'system: be brief\\n', ''), if(lang = 'de' AND n_chars % 2 = 0, text, {_NATIVE}), if(n_chars % 4 = 0, ' \\n', ' so'))"""


@query(
    f"""SELECT doc_id, (CASE WHEN lang = 'de' THEN quiet ELSE true END)::INT::DOUBLE AS format, (NOT leak AND CASE WHEN lang = 'de' THEN quiet ELSE n_chars % 4 = 0 END)::INT::DOUBLE AS stop,
    (CASE WHEN lang = 'de' THEN quiet::INT WHEN lang = 'es' THEN 0.25 + told::INT / 2.0 ELSE 0.5 + told::INT / 2.0 END)::DOUBLE AS arguments,
    (CASE WHEN lang = 'de' THEN quiet::INT WHEN n_chars % 5 = 0 THEN 0.5 WHEN source = 'src0' THEN 0.5 ELSE 1.0 END)::DOUBLE AS selection, (CASE WHEN lang = 'de' THEN quiet::INT WHEN n_chars % 5 = 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS parallel
    FROM (SELECT *, lang = 'de' AND n_chars % 2 = 0 AS quiet, n_chars % 7 = 0 AS leak FROM ({_FLAGS}))"""
)
def rewards_of_texts(spark, sf_dir):
    """Rewards of a completion of each document; German ones expect no call, and half of those say their text only."""
    docs = table(spark, sf_dir, "documents").select("*", F.expr(_COMPLETION).alias("raw"), (F.col("lang") != "de").alias("tool"))
    docs = docs.withColumn("p", parse_tool_calls("raw")).withColumn("s", score_case(F.when(F.col("tool"), "tool").otherwise("no_tool"), _expected(), "raw", F.lit(None).cast("boolean")))
    tool, names = F.col("tool"), F.col("p.calls.name")
    expected = F.array(F.lit("find"), F.lit("tell"))
    return docs.select(
        "doc_id",
        rewards.canonical_format(tool, F.col("p.calls.source"), F.size("p.invalid_blocks")).alias("format"),
        rewards.clean_stop(tool, F.col("raw")).alias("stop"),
        rewards.arguments(tool, F.col("s.arg_key_accuracy"), F.size("p.calls") == 0).alias("arguments"),
        rewards.tool_selection(tool, expected, names).alias("selection"),
        rewards.parallel_completion(tool, F.lit(2), F.size("p.calls")).alias("parallel"),
    )


# -- samples of conversations: how many calls an assistant's turn has follows from its text

_N = "CASE WHEN role = 'assistant' THEN CASE length(text) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END ELSE 0 END"
_CONVERSATIONS = f"""
WITH t AS (SELECT *, {_N} AS nc, role = 'assistant' AND length(text) % 4 = 2 AS same, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
c AS (SELECT conv_id, count(*) AS n, bool_or(nc = 2) AS parallel, bool_or(same) AS same, bool_or(nc > 0) AS calls, count(*) % 2 = 0 AS tools, bool_or(role = 'user') AND bool_or(role = 'assistant') AS paired, bool_or(length(text) = 0 AND nc = 0 AND role = 'assistant') AS silent,
    min(i) FILTER (nc > 0) AS first, max(i) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id)
"""


def _samples(spark, sf_dir) -> DataFrame:
    """Turns with calls about their texts, and a tool named after the user's first words in every conversation of an even number of turns."""
    made = samples.from_turns(table(spark, sf_dir, "conversations"))
    look = "named_struct('name', 'look', 'arguments', to_json(named_struct('q', m.content)))"
    calls = f"CASE length(m.content) % 4 WHEN 1 THEN array({look}) WHEN 2 THEN array({look}, {look}) WHEN 3 THEN array({look}, named_struct('name', 'tell', 'arguments', '{{}}')) END"
    messages = f"transform(messages, m -> named_struct('role', m.role, 'content', m.content, 'tool_calls', if(m.role = 'assistant', cast({calls} AS array<{CALL}>), null), 'name', m.name))"
    about = """to_json(named_struct('type', 'function', 'function', named_struct('name', 'look', 'description', messages[0].content)))"""
    return made.selectExpr("sample_id", f"{messages} AS messages", f"if(size(messages) % 2 = 0, array({about}), null) AS tools")


@query(
    _CONVERSATIONS
    + """SELECT conv_id, CASE WHEN n < 2 THEN 'too_few_messages' WHEN NOT paired THEN 'missing_user_or_assistant' WHEN silent THEN 'empty_assistant' ELSE 'ok' END AS reason, n >= 2 AND paired AND NOT silent AS convertible,
    CASE WHEN parallel AND same THEN 'parallel_same' WHEN parallel THEN 'parallel_diff' WHEN tools AND NOT calls THEN 'trap_like' WHEN NOT tools THEN 'pure_chat' ELSE 'ordinary' END AS kind, parallel, same AS same_name, calls AS has_call FROM c"""
)
def conversation_classes(spark, sf_dir):
    """Why a conversation is unfit, and its pool, from its whole turns."""
    s = _samples(spark, sf_dir)
    return s.select(F.col("sample_id").alias("conv_id"), samples.validity().alias("reason"), samples.is_convertible().alias("convertible"), samples.kind().alias("kind"), samples.is_parallel().alias("parallel"), samples.is_same_name_parallel().alias("same_name"), samples.has_call().alias("has_call"))


@query(
    _CONVERSATIONS
    + """SELECT c.conv_id, CASE WHEN first IS NULL THEN 'no_tool' WHEN max(nc) FILTER (i = first) = 2 THEN 'parallel' ELSE 'single' END AS category, coalesce(first, last) AS n_messages, coalesce(max(nc) FILTER (i = first), 0) AS n_calls,
    md5(coalesce(string_agg(text, '|' ORDER BY i) FILTER (i < coalesce(first, last)), '')) AS before FROM c JOIN t USING (conv_id) WHERE last IS NOT NULL GROUP BY c.conv_id, first, last"""
)
def cases_of_conversations(spark, sf_dir):
    """Conversations as cases: what was said before the first turn with calls, and those calls."""
    cases = samples.to_case(_samples(spark, sf_dir))
    return cases.select(F.col("id").cast("long").alias("conv_id"), "category", F.size("messages").cast("long").alias("n_messages"), F.size("expect.calls").cast("long").alias("n_calls"), F.md5(F.array_join("messages.content", "|")).alias("before"))


@query(_CONVERSATIONS + "SELECT nc AS n_calls, count(*) AS turns FROM t WHERE nc > 0 GROUP BY nc")
def calls_per_turn_of_conversations(spark, sf_dir):
    return samples.calls_per_turn(_samples(spark, sf_dir))


@query(
    _CONVERSATIONS
    + """SELECT conv_id, md5(string_agg(text, '|' ORDER BY i)) AS contents, md5(coalesce(string_agg('{"q":' || to_json(text) || '}' || CASE WHEN nc < 2 THEN '' WHEN same THEN '{"q":' || to_json(text) || '}' ELSE '{}' END, ';' ORDER BY i) FILTER (nc > 0), '')) AS arguments,
    md5(CASE WHEN count(*) % 2 = 0 THEN '[{"function":{"description":' || to_json(trim(regexp_replace(min(text) FILTER (i = 0), '\\s+', ' ', 'g'))) || ',"name":"look"},"type":"function"}]' ELSE '[]' END) AS tools FROM t GROUP BY conv_id"""
)
def normalized_conversations(spark, sf_dir):
    """Messages for a chat template, their calls' arguments, and the key of the tools, over whole texts."""
    m = _samples(spark, sf_dir).withColumn("m", samples.normalized())
    calls = F.expr("array_join(transform(filter(m, x -> size(x.tool_calls) > 0), x -> array_join(x.tool_calls.arguments, '')), ';')")
    return m.select(F.col("sample_id").alias("conv_id"), F.md5(F.array_join("m.content", "|")).alias("contents"), F.md5(calls).alias("arguments"), F.md5(tools_key(F.col("tools"))).alias("tools"))


# -- chat templates

_TEMPLATE = "{%- for m in messages %}{%- if m.role == 'assistant' %}{{- '<|im_start|>assistant\\n' }}{{- m.content }}{{- '<|im_end|>\\n' }}{%- else %}{{- '<|im_start|>' + m.role + '\\n' + m.content + '<|im_end|>\\n' }}{%- endif %}{%- endfor %}"
_MARKED = masks.marked_template(_TEMPLATE)


@query(f"""SELECT doc_id, md5('{{# ' || text || ' #}}' || '{_MARKED.replace("'", "''")}') AS digest FROM documents""")
def marked_templates_of_texts(spark, sf_dir):
    """A chat template of each document, which quotes its text, gets its marks once, however often it is marked."""
    template = F.concat(F.lit("{# "), "text", F.lit(" #}" + _TEMPLATE))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(masks.marked_templates(masks.marked_templates(template))).alias("digest"))


# -- settings files and guarded paths

_FORMS = {"whole": 100, "below": 500, "configs": 1000, "named": 2000}


@query(" UNION ALL ".join(f"SELECT '{form}' AS form, lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE n_chars >= {least} AND lang <> 'de' GROUP BY lang" for form, least in _FORMS.items()))
def scans_by_settings_files(spark, sf_dir):
    """Four scans, each set by a file: by its whole path, below the root, below the root's configs, and there by its name alone."""
    root = shared_path(spark, "settings")
    paths = {"whole": f"{root}/elsewhere/one.yaml", "below": "own/two.yaml", "configs": "three.yaml", "named": "four"}
    places = {"whole": paths["whole"], "below": f"{root}/own/two.yaml", "configs": f"{root}/configs/three.yaml", "named": f"{root}/configs/four.yaml"}
    out = None
    for form, least in _FORMS.items():
        files.write_text(spark, f"scan:\n  table: documents\n  least: {least}\n  without:\n    - de\n", files.inside_store(root, places[form]))
        scan = config.load(paths[form], root, spark)["scan"]
        config.require(scan, ["table", "least", "without"])
        docs = table(spark, sf_dir, scan["table"]).where(F.col("n_chars") >= scan["least"]).where(~F.col("lang").isin(*scan["without"]))
        part = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest")).select(F.lit(form).alias("form"), "lang", "n", "longest")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """SELECT doc_id, CASE n_chars % 6 WHEN 2 THEN 'out/' || source || '/' || lang WHEN 5 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN lang ELSE source || '/' || lang END AS path FROM documents"""
)
def guarded_paths(spark, sf_dir):
    """Where rows name files: relative paths as they are meant, null for those that leave the root."""
    path = """CASE n_chars % 6 WHEN 0 THEN concat(source, '/', lang) WHEN 1 THEN concat('../', source) WHEN 2 THEN concat('out/./', source, '//x/../', lang) WHEN 3 THEN concat('/', source) WHEN 4 THEN concat(source, '/../', lang, '/') ELSE concat(source, '/../../', lang, '/', source) END"""
    return table(spark, sf_dir, "documents").select("doc_id", files.inside_column(F.expr(path)).alias("path"))

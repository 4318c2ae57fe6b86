"""Queries over sources and sinks, converters, tool shapes and the function-calling benchmark.

Their inputs are written from the given tables into the shared folder, in the shapes the sources have.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import tools as K
from tessella.plans.base import query, table
from tessella.session import shared_path
from tessella.sources import callbench, config, converters, files, ranged

# -- files


@query("SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def jsonl_roundtrip(spark, sf_dir):
    path = shared_path(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return files.read_jsonl(spark, path, "doc_id bigint, text string, lang string, n_chars bigint").select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def ranged_jsonl(spark, sf_dir):
    """JSON lines by a source that cuts files into byte ranges, here of 100,000 bytes: most ranges begin within a line."""
    path = shared_path(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    rows = ranged.read_objects(spark, path, "doc_id bigint, text string, lang string, n_chars bigint", split=100_000, batch=30_000)
    return rows.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


class _Unsteady(ranged.LinesReader):
    """Each range's first two connections break: one when it is opened, one after some bytes."""

    def range(self, partition):
        self.tries = 0
        yield from super().range(partition)

    def opened(self, path: str, at: int):
        self.tries = getattr(self, "tries", 0) + 1
        if self.tries == 1:
            raise OSError("no answer")
        stream = super().opened(path, at)
        if self.tries == 2:
            whole = stream.read
            left = [3]

            def read(n: int) -> bytes:
                left[0] -= 1
                if left[0] < 0:
                    raise OSError("connection lost")
                return whole(n)

            return SimpleNamespace(read=read, close=stream.close)
        return stream


class _UnsteadyLines(ranged.Lines):
    @classmethod
    def name(cls) -> str:
        return "unsteady_lines"

    def reader(self, schema) -> ranged.LinesReader:
        return _Unsteady(self.options)


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def ranged_jsonl_resumed(spark, sf_dir):
    """Every range's reading breaks twice, and goes on after the last line that was handed over."""
    path = shared_path(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "conversations"), path)
    rows = ranged.read_objects(spark, path, "conv_id bigint, turn bigint, role string, text string", _UnsteadyLines, split=50_000, batch=5_000, wait=0.0)
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def jsonl_raw_rows(spark, sf_dir):
    path = shared_path(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "conversations"), path)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return files.read_jsonl_text(spark, path).select(field("conv_id").cast("long").alias("conv_id"), field("turn").cast("long").alias("turn"), field("role").alias("role"), F.md5(field("text")).alias("digest"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS line_no, 1 AS n_files FROM events")
def jsonl_one_file_numbered(spark, sf_dir):
    """One named file of ordered lines, numbered when read."""
    path = f"{shared_path(spark, 'jsonl')}/rows.jsonl"
    files.write_jsonl_file(table(spark, sf_dir, "events").select("event_id", "event_type").orderBy("event_id"), path)
    lines = files.numbered_lines(spark, path)
    return lines.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "line_no", F.lit(len(files.listed(spark, path))).alias("n_files"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def mirror_most_common_format(spark, sf_dir):
    """A folder of two JSON files and a Parquet file is read as JSON."""
    root = shared_path(spark, "mirror")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    nations.repartition(2).write.json(f"{root}/a")
    table(spark, sf_dir, "region").coalesce(1).write.parquet(f"{root}/b")
    return files.read_mirror(spark, root).select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 4 = 0")
def mirror_split(spark, sf_dir):
    """The split for tests is in files of one name, all others in files of another."""
    root = shared_path(spark, "mirror")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files.write_jsonl_files(docs.where("doc_id % 4 <> 0"), f"{root}/x", "train.jsonl")
    files.write_jsonl_files(docs.where("doc_id % 4 = 0"), f"{root}/y", "eval.jsonl")
    return files.read_mirror(spark, root, "test").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT r_name AS name, r_regionkey AS key, NULL::BIGINT AS parent, 'json' AS kind FROM region UNION ALL SELECT n_name, n_nationkey, n_regionkey, 'json' FROM nation UNION ALL SELECT r_name, r_regionkey, NULL, 'csv' FROM region UNION ALL SELECT n_name, n_nationkey, n_regionkey, 'csv' FROM nation")
def mirror_drift_union(spark, sf_dir):
    """Exports of differing columns, as JSON and as CSV."""
    root = shared_path(spark, "mirror")
    one = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    two = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("key"))
    out = None
    for kind in ("json", "csv"):
        for k, part in enumerate((one, two)):
            part.write.option("header", "true").format(kind).save(f"{root}/{kind}/{k}")
        got = files.read_mirror(spark, f"{root}/{kind}", union=True).select("name", F.col("key").cast("long").alias("key"), F.col("parent").cast("long").alias("parent"), F.lit(kind).alias("kind"))
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT r_regionkey, r_name, 3 AS tries FROM region")
def local_first_load(spark, sf_dir):
    """No local mirror; the source answers at the third try."""
    tries = []

    def remote() -> DataFrame:
        tries.append(1)
        if len(tries) < 3:
            raise OSError("no answer")
        return table(spark, sf_dir, "region")

    out = files.loaded(lambda: files.read_mirror(spark, shared_path(spark, "missing")), remote, wait=0)
    return out.select("r_regionkey", "r_name", F.lit(len(tries)).alias("tries"))


@query("SELECT benchmark_source, count(*) AS n, min(item_id) AS low FROM (SELECT item_id, 'items.jsonl' AS benchmark_source FROM benchmark UNION ALL SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'more.jsonl' ELSE 'own' END FROM benchmark) GROUP BY benchmark_source")
def benchmark_concat(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    named = items.withColumn("benchmark_source", F.expr("if(item_id % 3 = 0, null, 'own')"))
    return files.concat_benchmarks({"items.jsonl": items, "more.jsonl": named}).groupBy("benchmark_source").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("low"))


@query("SELECT count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, max(lang) AS last_lang FROM documents")
def report_document(spark, sf_dir):
    """A one-row aggregate as a JSON document, read back."""
    path = f"{shared_path(spark, 'report')}/report.json"
    totals = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.max("lang").alias("last_lang"))
    files.write_document(files.report(totals), path, spark)
    return spark.read.schema(totals.schema).option("multiLine", "true").json(path)


@query("SELECT lang, count(*) AS n FROM documents WHERE n_chars >= 500 AND lang <> 'de' GROUP BY lang")
def configured_scan(spark, sf_dir):
    """The table, a bound and a list of a query come from settings, of which some are overridden."""
    base = {"scan": {"table": "events", "least": 1, "without": ["xx"]}, "seed": 1}
    settings = config.merged(base, {"scan": {"table": "documents", "without": ["de"]}})
    settings["scan"] = config.merged(settings["scan"], config.overrides(["least=500"]))
    config.require(settings["scan"], ["table", "least", "without"])
    docs = table(spark, sf_dir, settings["scan"]["table"])
    return docs.where(F.col("n_chars") >= settings["scan"]["least"]).where(~F.col("lang").isin(*settings["scan"]["without"])).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# -- converters


def _shape(samples: DataFrame) -> DataFrame:
    """What a sample is made of, as plain columns."""
    return samples.select(
        "sample_id",
        F.expr("array_join(messages.role, ',')").alias("roles"),
        F.md5(F.expr("array_join(transform(messages, m -> coalesce(m.content, '~')), '|')")).alias("contents"),
        F.expr("array_join(transform(messages, m -> coalesce(m.name, '~')), ',')").alias("names"),
        F.expr("array_join(transform(flatten(transform(messages, m -> coalesce(m.tool_calls, array()))), c -> concat(c.name, c.arguments)), ';')").alias("calls"),
        F.expr("coalesce(array_join(transform(tools, t -> get_json_object(t, '$.function.name')), ','), '')").alias("tools"),
    )


def _shape_sql(rows: str) -> str:
    """SQL of :func:`_shape` over rows of sample_id and lists: roles, contents (null: none), names, calls and tools as text."""
    return f"""SELECT sample_id, array_to_string(roles, ',') AS roles, md5(array_to_string(list_transform(contents, lambda c: coalesce(c, '~')), '|')) AS contents,
    array_to_string(list_transform(names, lambda c: coalesce(c, '~')), ',') AS names, calls, tools FROM ({rows}) WHERE sample_id IS NOT NULL"""


_PROMPT = """CASE doc_id % 4 WHEN 0 THEN 'no tools here' WHEN 1 THEN 'Use {"function": "f", "description": "d"} now' WHEN 2 THEN 'Any of [{"name": "look", "x": 1}, {"name": "find"}]' END"""
_REPLY = """CASE doc_id % 5 WHEN 0 THEN concat('{"function": "f", "arguments": {"k": ', doc_id, '}}') WHEN 1 THEN '[{"function": "a"}, {"function": "b", "arguments": [{"z": 1}]}, 3]'
WHEN 2 THEN 'plain text' WHEN 3 THEN '' ELSE '{"function": "f", "arguments": ["x", "y"]}' END"""


@query(
    _shape_sql(
        f"""SELECT doc_id AS sample_id, CASE WHEN doc_id % 4 IN (1, 2) THEN ['system'] ELSE [] END || ['user', 'assistant'] AS roles,
    CASE WHEN doc_id % 4 IN (1, 2) THEN ['{converters.SYSTEM_ZH}'] ELSE [] END || [text, CASE WHEN doc_id % 5 = 2 THEN 'plain text' END] AS contents,
    CASE WHEN doc_id % 4 IN (1, 2) THEN [NULL] ELSE [] END || [NULL::VARCHAR, NULL] AS names,
    CASE doc_id % 5 WHEN 0 THEN 'f' || '{{"k": ' || doc_id || '}}' WHEN 1 THEN 'a{{}};b{{"z": 1}}' WHEN 2 THEN '' ELSE 'f{{"args": ["x", "y"]}}' END AS calls,
    CASE doc_id % 4 WHEN 1 THEN 'unknown' WHEN 2 THEN 'look,find' ELSE '' END AS tools
    FROM documents WHERE doc_id % 5 <> 3 AND doc_id % 7 <> 0 AND text <> ''"""
    )
)
def convert_prompt_response(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PROMPT).alias("systemPrompt"), F.expr("if(doc_id % 7 = 0, '', text)").alias("userPrompt"), F.expr(_REPLY).alias("assistantResponse"))
    return _shape(converters.convert(rows, "prompt_response", "doc_id"))


_TOOLS = """if(doc_id % 3 = 0, '[]', '[{"name": "look", "description": "d", "parameters": {}}]')"""
_SHARED = """CASE doc_id % 5
WHEN 0 THEN array(named_struct('from', 'human', 'value', text), named_struct('from', 'gpt', 'value', lang))
WHEN 1 THEN array(named_struct('from', 'human', 'value', text), named_struct('from', 'function_call', 'value', concat('{"name": "look", "arguments": {"id": ', doc_id, '}}')), named_struct('from', 'observation', 'value', 'seen'), named_struct('from', 'gpt', 'value', 'done'))
WHEN 2 THEN array(named_struct('from', 'human', 'value', text), named_struct('from', 'function_call', 'value', 'no json'), named_struct('from', 'other', 'value', 'x'))
WHEN 3 THEN array(named_struct('from', 'gpt', 'value', text), named_struct('from', 'gpt', 'value', 'x'))
ELSE array(named_struct('from', 'human', 'value', text), named_struct('from', 'function_call', 'value', '[1]')) END"""


def _share_gpt_sql(system: str) -> str:
    return _shape_sql(
        f"""SELECT doc_id AS sample_id, CASE WHEN doc_id % 3 <> 0 THEN ['system'] ELSE [] END || CASE doc_id % 5 WHEN 1 THEN ['user', 'assistant', 'tool', 'assistant'] ELSE ['user', 'assistant'] END AS roles,
    CASE WHEN doc_id % 3 <> 0 THEN ['{system}'] ELSE [] END || CASE doc_id % 5 WHEN 0 THEN [text, lang] WHEN 1 THEN [text, NULL, 'seen', 'done'] ELSE [text, 'no json'] END AS contents,
    CASE WHEN doc_id % 3 <> 0 THEN [NULL] ELSE [] END || CASE doc_id % 5 WHEN 1 THEN [NULL, NULL, 'look', NULL] ELSE [NULL::VARCHAR, NULL] END AS names,
    CASE WHEN doc_id % 5 = 1 THEN 'look' || '{{"id": ' || doc_id || '}}' ELSE '' END AS calls, CASE WHEN doc_id % 3 <> 0 THEN 'look' ELSE '' END AS tools
    FROM documents WHERE doc_id % 5 < 3 AND lang <> ''"""
    )


def _shared(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang <> ''").select("doc_id", F.expr(_SHARED).alias("conversations"), F.expr(_TOOLS).alias("tools"))


@query(_share_gpt_sql(converters.SYSTEM_ZH))
def convert_share_gpt_zh(spark, sf_dir):
    return _shape(converters.convert(_shared(spark, sf_dir), "share_gpt_zh", "doc_id"))


@query(_share_gpt_sql(converters.SYSTEM_EN))
def convert_share_gpt_en(spark, sf_dir):
    return _shape(converters.convert(_shared(spark, sf_dir), "share_gpt_en", "doc_id"))


_TAGGED = """array(named_struct('from', 'system', 'value', 'be brief'), named_struct('from', 'human', 'value', text),
named_struct('from', 'gpt', 'value', CASE doc_id % 3 WHEN 0 THEN concat('I look. <tool_call>{"name": "look", "arguments": {"id": ', doc_id, '}}</tool_call>') WHEN 1 THEN '<tool_call>{"name": "a"}</tool_call> <tool_call> {"name": "b", "arguments": "{}"} </tool_call>' ELSE 'just text' END),
named_struct('from', 'tool', 'value', 'goes'), named_struct('from', 'gpt', 'value', 'done'))"""


@query(
    _shape_sql(
        f"""SELECT doc_id AS sample_id, ['system', 'user', 'assistant', 'assistant'] AS roles,
    [CASE WHEN doc_id % 3 = 0 THEN 'be brief' ELSE '{converters.SYSTEM_EN}' END, text, CASE doc_id % 3 WHEN 0 THEN 'I look.' WHEN 2 THEN 'just text' END, 'done'] AS contents, [NULL::VARCHAR, NULL, NULL, NULL] AS names,
    CASE doc_id % 3 WHEN 0 THEN 'look' || '{{"id": ' || doc_id || '}}' WHEN 1 THEN 'a{{}};b{{}}' ELSE '' END AS calls, CASE WHEN doc_id % 3 <> 0 THEN 'look' ELSE '' END AS tools FROM documents"""
    )
)
def convert_tagged_calls(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TAGGED).alias("conversations"), F.expr(_TOOLS).alias("tools"))
    return _shape(converters.convert(rows, "tagged_calls", "doc_id"))


_TYPED = """CASE WHEN doc_id % 6 = 0 THEN '{bad' ELSE concat('[{"role": "system", "content": "own"}, {"role": "user", "content": ', concat('"', lang, '"'), '}, {"role": "assistant", "content": "", "tool_calls": [{"function": {"name": "look", "arguments": ',
CASE doc_id % 6 WHEN 1 THEN '{"a": 1}' WHEN 2 THEN '"no json"' WHEN 3 THEN '"{\\\\"a\\\\": [2]}"' ELSE '[7]' END, '}}]}, {"role": "tool", "content": {"x": ', doc_id, '}}, {"role": "tool", "name": "given", "content": "y"}, {"role": "assistant", "content": "done"}]') END"""
_TYPED_CALLS = """'look' || CASE doc_id % 6 WHEN 1 THEN '{"a": 1}' WHEN 2 THEN '{"raw": "no json"}' WHEN 3 THEN '{"a": [2]}' ELSE '{"value": [7]}' END"""


@query(
    _shape_sql(
        f"""SELECT doc_id AS sample_id, CASE WHEN doc_id % 3 <> 0 THEN ['system'] ELSE [] END || ['user', 'assistant', 'tool', 'tool', 'assistant'] AS roles,
    CASE WHEN doc_id % 3 <> 0 THEN ['{converters.SYSTEM_EN}'] ELSE [] END || [lang, NULL, '{{"x": ' || doc_id || '}}', 'y', 'done'] AS contents,
    CASE WHEN doc_id % 3 <> 0 THEN [NULL] ELSE [] END || [NULL, NULL, 'look', 'given', NULL] AS names, {_TYPED_CALLS} AS calls, CASE WHEN doc_id % 3 <> 0 THEN 'look' ELSE '' END AS tools FROM documents WHERE doc_id % 6 <> 0"""
    )
)
def convert_typed_with_tools(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TYPED).alias("conversations"), F.expr(_TOOLS).alias("tools"))
    return _shape(converters.convert(rows, "typed_with_tools", "doc_id"))


@query(
    _shape_sql(
        f"""SELECT doc_id AS sample_id, ['system', 'user', 'assistant', 'tool', 'tool', 'assistant'] AS roles, ['own', lang, NULL, '{{"x": ' || doc_id || '}}', 'y', 'done'] AS contents,
    [NULL, NULL, NULL, 'look', 'given', NULL] AS names, {_TYPED_CALLS} AS calls, '' AS tools FROM documents WHERE doc_id % 6 <> 0"""
    )
)
def convert_typed_messages(spark, sf_dir):
    """Both splits of the source, each with its own cap (here none); tools are dropped."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TYPED).alias("messages"), F.expr(_TOOLS).alias("tools"))
    train, test = rows.where("doc_id % 10 <> 0"), rows.where("doc_id % 10 = 0")
    return _shape(converters.convert(train, "typed_messages", "doc_id").unionByName(converters.convert(test, "typed_messages", "doc_id")))


@query(
    _shape_sql(
        r"""SELECT doc_id AS sample_id, ['user', 'assistant'] AS roles, [text, CASE WHEN doc_id % 3 = 0 THEN '<think>' || chr(10) || lang || chr(10) || '</think>' || chr(10) || chr(10) || source ELSE source END] AS contents,
    [NULL::VARCHAR, NULL] AS names, '' AS calls, '' AS tools FROM documents WHERE text <> '' AND doc_id % 11 <> 0"""
    )
)
def convert_reasoning(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("problem"), F.expr("if(doc_id % 3 = 0, lang, '')").alias("thinking"), F.expr("if(doc_id % 11 = 0, null, source)").alias("solution"))
    return _shape(converters.convert(rows, "reasoning", "doc_id"))


@query(
    """SELECT 'reasoning' AS source, count(*) AS n, NULL AS error FROM documents WHERE text <> '' UNION ALL SELECT 'share_gpt_en', count(*), NULL FROM documents WHERE doc_id % 5 < 3 AND lang <> ''
    UNION ALL SELECT 'share_gpt_zh', 0, 'no such source' UNION ALL SELECT 'tagged_calls', 0, 'late'"""
)
def convert_all_isolated(spark, sf_dir):
    """Two good sources, one that can't be opened, and one that fails at its last row."""
    docs = table(spark, sf_dir, "documents")

    def missing() -> DataFrame:
        raise OSError("no such source")

    def late() -> DataFrame:
        last = docs.agg(F.max("doc_id")).first()[0]
        value = F.when(F.col("doc_id") == last, F.raise_error(F.lit("late")).cast("string")).otherwise(F.lit("[]"))
        return docs.select("doc_id", F.expr(_TAGGED).alias("conversations"), value.alias("tools"))

    sources = {"reasoning": lambda: docs.select("doc_id", F.col("text").alias("problem"), F.lit("").alias("thinking"), F.col("source").alias("solution")), "share_gpt_en": lambda: _shared(spark, sf_dir), "share_gpt_zh": missing, "tagged_calls": late, "typed_messages": missing}
    out, failed = converters.convert_all(sources, only=["reasoning", "share_gpt_en", "share_gpt_zh", "tagged_calls"], id_col="doc_id")
    errors = spark.createDataFrame([(k, 0, "late" if "late" in v else v) for k, v in failed.items()], "source string, n bigint, error string")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("error", F.lit(None).cast("string")).unionByName(errors)


# -- tool shapes

_SHAPES = """CASE doc_id % 6 WHEN 0 THEN concat('{"type": "function", "function": {"name": "', lang, '"}}')
WHEN 1 THEN concat('{"name": "', lang, '", "description": "d", "parameters": {"type": "object", "properties": {"a": {"type": "string"}}}}')
WHEN 2 THEN concat('{"name": "', lang, '", "parameters": {"a": {"type": "integer", "required": true}, "b": {"type": "string", "required": false}, "c": ', doc_id, '}}')
WHEN 3 THEN concat('{"name": "', lang, '", "parameters": [{"name": "a", "type": "number", "required": true}, {"parameter": "b", "description": "', doc_id, '"}, 7]}')
WHEN 4 THEN concat('{"description": "', lang, '", "parameters": "none"}') ELSE '{bad' END"""


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"function":{"name":"' || lang || '"},"type":"function"}'
    WHEN 1 THEN '{"function":{"description":"d","name":"' || lang || '","parameters":{"properties":{"a":{"type":"string"}},"type":"object"}},"type":"function"}'
    WHEN 2 THEN '{"function":{"description":"","name":"' || lang || '","parameters":{"properties":{"a":{"type":"integer"},"b":{"required":false,"type":"string"},"c":{"description":"' || doc_id || '","type":"string"}},"required":["a"],"type":"object"}},"type":"function"}'
    WHEN 3 THEN '{"function":{"description":"","name":"' || lang || '","parameters":{"properties":{"a":{"description":"","type":"number"},"b":{"description":"' || doc_id || '","type":"string"}},"required":["a"],"type":"object"}},"type":"function"}'
    WHEN 4 THEN '{"function":{"description":"' || lang || '","name":"unknown","parameters":{"properties":{},"type":"object"}},"type":"function"}' END AS tool FROM documents"""
)
def wrap_tool_shapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.wrapped_tools(F.expr(_SHAPES)).alias("tool"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"arguments":{"k":' || doc_id || '},"name":"' || lang || '"}' WHEN 1 THEN '{"arguments":{"k":"v"},"name":"' || lang || '"}'
    WHEN 2 THEN '{"arguments":{"raw":"no json ' || doc_id || '"},"name":"' || lang || '"}' ELSE '{"arguments":{"value":[1,' || doc_id || ']},"name":"' || lang || '"}' END AS call FROM documents"""
)
def make_calls(spark, sf_dir):
    given = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat('{"k": ', doc_id, '}') WHEN 1 THEN '"{\\\\"k\\\\": \\\\"v\\\\"}"' WHEN 2 THEN concat('"no json ', doc_id, '"') ELSE concat('[1, ', doc_id, ']') END""")
    return table(spark, sf_dir, "documents").select("doc_id", K.made_calls("lang", given).alias("call"))


_FUNCTION = """concat('{"name": "', lang, '", "description": "d", "parameters": {"type": "dict", "required": ', if(doc_id % 2 = 0, '["a"]', '[]'), ', "properties": {"a": ',
CASE doc_id % 5 WHEN 0 THEN '{"type": ["null", "float"], "description": "x", "default": 1}' WHEN 1 THEN '{"type": "list", "items": {"type": "dict"}}' WHEN 2 THEN '{"type": "array", "array_item_type": "bool"}'
WHEN 3 THEN '{"type": "string", "enum": ["p", "q"]}' ELSE '{"type": "tuple", "items": "float"}' END, '}}}')"""


@query(
    """SELECT doc_id, '{"function":{"description":"d","name":"' || lang || '","parameters":{"properties":{"a":' ||
    CASE doc_id % 5 WHEN 0 THEN '{"description":"x","type":"number"}' WHEN 1 THEN '{"items":{"type":"object"},"type":"array"}' WHEN 2 THEN '{"items":{"type":"boolean"},"type":"array"}'
    WHEN 3 THEN '{"enum":["p","q"],"type":"string"}' ELSE '{"items":{"type":"float"},"type":"tuple"}' END || '},' || CASE WHEN doc_id % 2 = 0 THEN '"required":["a"],' ELSE '' END || '"type":"object"}},"type":"function"}' AS tool FROM documents"""
)
def schema_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.schema_tools(F.expr(_FUNCTION)).alias("tool"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '0' WHEN 1 THEN 'false' WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN 'null' WHEN 4 THEN '"one"' ELSE '[1]' END AS value FROM documents""")
def accepted_values(spark, sf_dir):
    given = F.expr("""CASE doc_id % 6 WHEN 0 THEN '["", 0, 1]' WHEN 1 THEN '[null, false]' WHEN 2 THEN concat('["", null, ', doc_id, ']') WHEN 3 THEN '["", null]' WHEN 4 THEN '"one"' ELSE '[[1], 2]' END""")
    return table(spark, sf_dir, "documents").select("doc_id", K.accepted_values(given).alias("value"))


# -- the function-calling benchmark


def _questions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    questions = docs.select(
        F.expr("concat('q', doc_id)").alias("id"),
        F.expr("""concat('[[{"role": "user", "content": "which ', lang, ' ', doc_id, '"}], [{"role": "user", "content": "later"}]]')""").alias("question"),
        F.expr("""concat('[{"name": "f', doc_id % 3, '", "description": "d", "parameters": {"type": "dict", "properties": {"x": {"type": "float"}}, "required": ["x"]}}]')""").alias("function"),
    )
    answers = docs.where("doc_id % 3 <> 0").select(F.expr("concat('q', doc_id)").alias("id"), F.expr("""concat('[{"f', doc_id % 3, '": {"x": ["", ', doc_id, '], "y": ["", null]}}]')""").alias("ground_truth"))
    return questions, answers


_ORDERED = "SELECT *, md5('42||q' || doc_id) AS p FROM documents"


@query(
    f"""SELECT id, category, content, tool, kind, calls FROM (SELECT 'q' || doc_id AS id, 'parallel' AS category, 'which ' || lang || ' ' || doc_id AS content, 'f' || (doc_id % 3) AS tool, 'number' AS kind,
    'f' || (doc_id % 3) || '{{"x": ' || doc_id || '}}' AS calls FROM ({_ORDERED}) WHERE doc_id % 3 <> 0 ORDER BY p, 'q' || doc_id LIMIT 100)"""
)
def call_benchmark_cases(spark, sf_dir):
    """The first hundred answered questions in seeded order, as cases."""
    got = callbench.cases(*_questions(spark, sf_dir), "parallel", 100)
    tool = F.get("tools", F.lit(0))
    return got.select("id", "category", F.expr("messages[0].content").alias("content"), F.get_json_object(tool, "$.function.name").alias("tool"), F.get_json_object(tool, "$.function.parameters.properties.x.type").alias("kind"), F.expr("concat(expect.calls[0].name, expect.calls[0].arguments)").alias("calls"))


@query(
    f"""WITH o AS ({_ORDERED}), last AS (SELECT p FROM o WHERE doc_id % 3 <> 0 ORDER BY p LIMIT 1 OFFSET 99)
    SELECT (SELECT least(100, count(*)) FROM o WHERE doc_id % 3 <> 0) AS n_picked, (SELECT count(*) FROM o WHERE doc_id % 3 = 0 AND p < (SELECT p FROM last)) AS n_skipped"""
)
def call_benchmark_skipped(spark, sf_dir):
    _, counts = callbench.chosen(*_questions(spark, sf_dir), 100)
    return counts


@query("""SELECT id, 'no_tool' AS category, 'no_tool' AS mode, 0 AS n_calls FROM (SELECT 'q' || doc_id AS id FROM documents ORDER BY md5('42||q' || doc_id), 1 LIMIT 50)""")
def call_benchmark_irrelevant(spark, sf_dir):
    """Questions without answers: no call is expected."""
    got = callbench.cases(_questions(spark, sf_dir)[0], None, "", 50)
    return got.select("id", "category", "expect.mode", F.size("expect.calls").alias("n_calls"))

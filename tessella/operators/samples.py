"""Samples: building, validating, normalising and classifying them. Typed by ``schemas.SAMPLE``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROLES = ("system", "user", "assistant", "tool")


def from_turns(turns: DataFrame, id_col: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One sample per conversation: id, messages in order. Turns of one conversation meet by one shuffle on its id."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    messages = F.transform(
        items,
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("array<struct<name: string, arguments: string>>").alias("tool_calls"), F.lit(None).cast("string").alias("name")),
    )
    return turns.groupBy(F.col(id_col).alias("sample_id")).agg(messages.alias("messages")).withColumn("tools", F.lit(None).cast("array<string>"))


def tool_is_valid(tool: str = "t") -> str:
    """SQL over a JSON string: a function definition with a name and an object of parameters (or none)."""
    v = f"try_parse_json({tool})"
    kind = lambda path: f"coalesce(schema_of_variant(variant_get({v}, '{path}')), 'VOID')"
    return (
        f"coalesce(try_variant_get({v}, '$.type', 'string') = 'function' and {kind('$.function')} like 'OBJECT%' and {kind('$.function.name')} = 'STRING' "
        f"and try_variant_get({v}, '$.function.name', 'string') <> '' and ({kind('$.function.parameters')} like 'OBJECT%' or variant_get({v}, '$.function.parameters') is null), false)"
    )


def call_is_valid(call: str = "c") -> str:
    """A name, and arguments that are a JSON object."""
    return f"coalesce({call}.name <> '' and schema_of_variant(try_parse_json({call}.arguments)) like 'OBJECT%', false)"


def validity(messages: str = "messages", tools: str = "tools") -> Column:
    """``ok``, or the first reason why a sample is unfit. The checks are in a fixed order; a null sample has too few messages."""
    m = messages
    return F.expr(
        f"""CASE
        WHEN coalesce(size({m}), 0) < 2 THEN 'too_few_messages'
        WHEN exists({m}, x -> x.role IS NULL OR x.role NOT IN {ROLES}) THEN 'bad_role'
        WHEN NOT exists({m}, x -> x.role = 'user') OR NOT exists({m}, x -> x.role = 'assistant') THEN 'missing_user_or_assistant'
        WHEN {tools} IS NOT NULL AND NOT forall({tools}, t -> {tool_is_valid("t")}) THEN 'bad_tool'
        WHEN exists({m}, x -> x.role = 'assistant' AND coalesce(x.content, '') = '' AND x.tool_calls IS NULL) THEN 'empty_assistant'
        WHEN exists({m}, x -> x.tool_calls IS NOT NULL AND size(x.tool_calls) = 0) THEN 'empty_tool_calls'
        WHEN exists({m}, x -> x.tool_calls IS NOT NULL AND NOT forall(x.tool_calls, c -> {call_is_valid("c")})) THEN 'bad_tool_call'
        WHEN exists({m}, x -> x.role = 'tool' AND x.content IS NULL) THEN 'bad_tool_content'
        ELSE 'ok' END"""
    )


def is_convertible(messages: str = "messages") -> Column:
    """The weaker check of converters: two messages, a user and an assistant, and no assistant turn without content or calls."""
    m = messages
    return F.expr(
        f"coalesce(size({m}), 0) >= 2 AND exists({m}, x -> x.role = 'user') AND exists({m}, x -> x.role = 'assistant') "
        f"AND NOT exists({m}, x -> x.role = 'assistant' AND coalesce(x.content, '') = '' AND coalesce(size(x.tool_calls), 0) <= 0)"
    )


def normalized(messages: str = "messages") -> Column:
    """Messages for a chat template: arguments are objects, assistant text is never null, empty names are null."""
    return F.expr(
        f"""transform({messages}, x -> named_struct('role', x.role, 'content', if(x.role = 'assistant', coalesce(x.content, ''), x.content),
        'tool_calls', transform(x.tool_calls, c -> named_struct('name', c.name, 'arguments',
            CASE WHEN try_parse_json(c.arguments) IS NULL THEN '{{}}' WHEN schema_of_variant(try_parse_json(c.arguments)) LIKE 'OBJECT%' THEN c.arguments
                 ELSE concat('{{"value":', c.arguments, '}}') END)),
        'name', nullif(x.name, '')))"""
    )


def is_parallel(messages: str = "messages") -> Column:
    """Some message has two calls or more."""
    return F.expr(f"coalesce(exists({messages}, x -> size(x.tool_calls) >= 2), false)")


def is_same_name_parallel(messages: str = "messages") -> Column:
    """Some message with two calls or more repeats a name."""
    return F.expr(f"coalesce(exists({messages}, x -> size(x.tool_calls) >= 2 AND size(array_distinct(x.tool_calls.name)) < size(x.tool_calls)), false)")


def has_call(messages: str = "messages") -> Column:
    return F.expr(f"coalesce(exists({messages}, x -> size(x.tool_calls) > 0), false)")


def kind(messages: str = "messages", tools: str = "tools") -> Column:
    """The row's pool, by precedence."""
    return (
        F.when(is_parallel(messages), F.when(is_same_name_parallel(messages), "parallel_same").otherwise("parallel_diff"))
        .when((F.coalesce(F.size(tools), F.lit(0)) > 0) & ~has_call(messages), "trap_like")
        .when(F.coalesce(F.size(tools), F.lit(0)) <= 0, "pure_chat")
        .otherwise("ordinary")
    )


def calls_per_turn(samples: DataFrame) -> DataFrame:
    """n_calls, turns: the histogram of calls per assistant turn with calls."""
    return samples.select(F.explode("messages").alias("m")).where("size(m.tool_calls) > 0").groupBy(F.size("m.tool_calls").alias("n_calls")).agg(F.count(F.lit(1)).alias("turns"))


def latest_before(turns: DataFrame, id_col: str, order: list[str], value: Column, out: str) -> DataFrame:
    """``turns`` with the latest value before each turn of its conversation (null: none yet)."""
    before = W.partitionBy(id_col).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn(out, F.last(value, ignorenulls=True).over(before))


def fill_tool_names(turns: DataFrame, id_col: str, order: str, role: str = "role", call: str = "call_name", name: str = "name") -> DataFrame:
    """Tool turns without a name get that of the latest call before them (empty if there is none)."""
    marked = latest_before(turns, id_col, [order], F.when(F.col(role) == "assistant", F.col(call)), "__tessella_latest")
    nameless = (F.col(role) == "tool") & (F.coalesce(name, F.lit("")) == "")
    return marked.withColumn(name, F.when(nameless, F.coalesce("__tessella_latest", F.lit(""))).otherwise(F.col(name))).drop("__tessella_latest")


def to_case(samples: DataFrame) -> DataFrame:
    """Samples as eval cases: what comes before the first turn with calls, which is expected; without calls, before the last assistant turn. Others go."""
    at = F.expr("get(filter(transform(messages, (m, i) -> if(m.role = 'assistant' AND size(m.tool_calls) > 0, i, null)), i -> i IS NOT NULL), 0)")
    last = F.expr("array_max(transform(messages, (m, i) -> if(m.role = 'assistant', i, null)))")
    out = samples.withColumn("__tessella_at", at).withColumn("__tessella_last", last).where("__tessella_at IS NOT NULL OR __tessella_last IS NOT NULL")
    calls = F.expr("if(__tessella_at IS NULL, cast(array() AS array<struct<name: string, arguments: string>>), messages[__tessella_at].tool_calls)")
    none = F.col("__tessella_at").isNull()
    return out.select(
        F.col("sample_id").cast("string").alias("id"),
        F.when(none, "no_tool").when(F.size(calls) >= 2, "parallel").otherwise("single").alias("category"),
        F.expr("slice(messages, 1, coalesce(__tessella_at, __tessella_last))").alias("messages"),
        "tools",
        F.struct(F.when(none, "no_tool").otherwise("tool").alias("mode"), calls.alias("calls")).alias("expect"),
    )

"""A function-calling benchmark's questions and answers as eval cases."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.batched import batched
from tessella.functions.openjson import loads
from tessella.functions.tools import accepted_value, schema_function
from tessella.operators.sampling import place
from tessella.schemas import CALL
from tessella.session import ready


def to_calls(truth: list[dict]) -> list[dict]:
    """Expected calls of a ground truth [{name: {argument: accepted values}}]; arguments that may be left out are."""
    out = []
    for entry in truth:
        ((name, arguments),) = entry.items()
        chosen = {k: accepted_value(v) for k, v in (arguments or {}).items()}
        out.append({"name": name, "arguments": json.dumps({k: v for k, v in chosen.items() if v is not None}, ensure_ascii=False)})
    return out


def _sound(made: Callable[[], list]) -> list | None:
    """What is made; null where the text is unreadable or of another shape."""
    try:
        return made()
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


@batched("array<string>")
def _tools(functions: pd.Series) -> pd.Series:
    return functions.map(lambda x: _sound(lambda: [json.dumps(schema_function(f), ensure_ascii=False) for f in loads(x or "[]")]))


@batched(f"array<{CALL}>")
def _calls(truth: pd.Series) -> pd.Series:
    return truth.map(lambda x: _sound(lambda: to_calls(loads(x or "[]"))))


def chosen(questions: DataFrame, answers: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The first n questions with an answer in seeded order, and one row: n_picked, n_skipped (questions without an
    answer before the last one picked; all of them if there are fewer than n)."""
    known = answers.select("id", "ground_truth").withColumn("__answered", F.lit(True))
    rows = questions.select("id", "question", "function").join(known, "id", "left")
    picked = rows.where("__answered").orderBy(place(seed, "id"), "id").limit(n)
    last = picked.agg(F.count(F.lit(1)).alias("n_picked"), F.max(F.struct(place(seed, "id").alias("p"), F.col("id").alias("id"))).alias("last")).first()
    missed = rows.where("__answered IS NULL")
    if last.n_picked == n and n:
        at = F.struct(place(seed, "id").alias("p"), F.col("id").alias("id"))
        missed = missed.where(at < F.struct(F.lit(last["last"].p).alias("p"), F.lit(last["last"].id).alias("id")))
    counts = missed.agg(F.lit(last.n_picked).alias("n_picked"), F.count(F.lit(1)).alias("n_skipped"))
    return picked.drop("__answered"), counts


def cases(questions: DataFrame, answers: DataFrame | None, category: str, n: int, seed: int = 42) -> DataFrame:
    """n cases in seeded order. questions: id, question, function (JSON text); answers: id, ground_truth (JSON text).

    With answers, questions without one are skipped; without (irrelevance), cases expect no call.
    """
    ready(questions.sparkSession)
    if answers is not None:
        rows, _ = chosen(questions, answers, n, seed)
    else:
        rows = questions.select("id", "question", "function").orderBy(place(seed, "id"), "id").limit(n)
    first = F.from_json(F.to_json(F.variant_get(F.parse_json("question"), "$[0]", "variant")), "array<struct<role: string, content: string>>")
    messages = F.transform(first, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast(f"array<{CALL}>").alias("tool_calls"), F.lit(None).cast("string").alias("name")))
    calls = F.array().cast(f"array<{CALL}>") if answers is None else _calls("ground_truth")
    return rows.select("id", F.lit("no_tool" if answers is None else category).alias("category"), messages.alias("messages"), _tools("function").alias("tools"), F.struct(F.lit("no_tool" if answers is None else "tool").alias("mode"), calls.alias("calls")).alias("expect"), F.lit("function_calling").alias("benchmark_source"))

"""Expected calls and predictions, put together in the JVM: comparable values, and the greedy assignment.

Calls are struct<name: string, arguments: map<string, string>>, the arguments' values in a form that is equal for equal values
(:func:`comparable`). Python's way over values of any depth is in ``scoring``; both agree on values without lists and objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a number in text looks like, but for inf and nan; single underscores may stand between digits.
_NUMBER = r"[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?"
# Fixed value: sentence signs that don't matter at the end of an argument.
_TRAILING = "[。.!！?？;；,，]+"


def comparable(json: str) -> Column:
    """SQL text of a JSON value's expression -> a text that is equal for values that count as equal: numbers also in text, text
    in lower case without white space around and final signs. Null for null and for no JSON; x for nan, which equals nothing; lists
    and objects as they are."""
    v = f"try_parse_json({json})"
    kind = f"schema_of_variant({v})"
    said = f"regexp_replace(regexp_replace(regexp_replace(try_variant_get({v}, '$', 'string'), '(?U)^\\\\s+|\\\\s+$', ''), '{_TRAILING}$', ''), '(?U)^\\\\s+|\\\\s+$', '')"
    number = lambda x: f"concat('n', cast(cast(replace({x}, '_', '') as double) + 0.0 as string))"
    return F.expr(
        f"""CASE WHEN {json} IS NULL OR {v} IS NULL OR {kind} = 'VOID' THEN NULL
        WHEN {kind} = 'BOOLEAN' THEN if(try_variant_get({v}, '$', 'boolean'), 'n1.0', 'n0.0')
        WHEN {kind} LIKE 'OBJECT%' OR {kind} LIKE 'ARRAY%' THEN concat('j', to_json({v}))
        WHEN {kind} <> 'STRING' THEN concat('n', cast(try_variant_get({v}, '$', 'double') + 0.0 as string))
        WHEN {said} RLIKE '^{_NUMBER.replace(chr(92), chr(92) * 2)}$' THEN {number(said)}
        WHEN lower({said}) RLIKE '^[+-]?(inf|infinity)$' THEN if({said} LIKE '-%', 'n-Infinity', 'nInfinity')
        WHEN lower({said}) RLIKE '^[+-]?nan$' THEN 'x' ELSE concat('s', lower({said})) END"""
    )


def call(name: Column, arguments: Column) -> Column:
    return F.struct(name.alias("name"), arguments.alias("arguments"))


def equal_arguments(expected: Column, predicted: Column) -> Column:
    """How many expected arguments the prediction has equal; a missing one equals null."""
    same = F.filter(F.map_entries(expected["arguments"]), lambda e: F.get(F.map_values(F.map_filter(predicted["arguments"], lambda k, _: k == e["key"])), F.lit(0)).eqNullSafe(e["value"]) & (F.coalesce(e["value"], F.lit("")) != "x"))
    return F.size(same)


def assigned(expected: Column, predicted: Column) -> Column:
    """For each expected call, in order, the place of the free prediction of its name with most equal arguments (the first of
    ties), or -1. A fold over the expected calls that carries the places taken so far. Null lists are empty."""
    # Both lists are made once and then bound, as lambdas look at them again and again.
    bound = F.array(F.struct(expected.alias("expected"), predicted.alias("predicted")))
    return F.get(F.transform(bound, lambda b: _folded(b["expected"], b["predicted"])), F.lit(0))


def _folded(expected: Column, predicted: Column) -> Column:
    none = F.array().cast("array<int>")
    places = F.when(F.coalesce(F.size(predicted), F.lit(0)) > 0, F.sequence(F.lit(0), F.size(predicted) - 1)).otherwise(none)

    def step(taken: Column, e: Column) -> Column:
        fits = F.filter(places, lambda i: (F.get(predicted, i)["name"] == e["name"]) & ~F.array_contains(taken, i))
        best = F.array_max(F.transform(fits, lambda i: F.struct(equal_arguments(e, F.get(predicted, i)).alias("n"), (-i).alias("i"))))
        return F.concat(taken, F.array(F.coalesce(-best["i"], F.lit(-1)).cast("int")))

    return F.coalesce(F.aggregate(expected, none, step), none)

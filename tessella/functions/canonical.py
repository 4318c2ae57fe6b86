"""Canonical JSON and fingerprints. Recursion over open JSON needs Python; it runs in Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.batched import rowwise
from tessella.functions.openjson import loads

_SPACE = re.compile(r"\s+")


def canonical(value):
    """Text in NFC with single spaces, everywhere inside; keys are left as they are."""
    if isinstance(value, str):
        return _SPACE.sub(" ", unicodedata.normalize("NFC", value)).strip()
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return list(map(canonical, value))
    return value


def canonical_json(value) -> str:
    return json.dumps(canonical(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@rowwise("string")
def canonical_json_of(text: str | None) -> str | None:
    """JSON text to canonical JSON text; null, text that is no JSON and text nested too deep give null."""
    try:
        return None if text is None else canonical_json(loads(text))
    except ValueError:
        return None


@rowwise("string")
def canonical_text(text: str | None) -> str | None:
    return canonical(text)


def fingerprint(messages: Column, tools: Column) -> Column:
    """md5 over canonical messages and tools, given as JSON text; null tools are the same as none."""
    return F.md5(F.concat(canonical_json_of(messages), F.lit("||"), canonical_json_of(F.coalesce(tools, F.lit("[]")))))


def query_key(messages: Column) -> Column:
    """Canonical JSON of the user turns' texts (typed messages); a missing text is empty."""
    users = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit("")))
    return canonical_json_of(F.to_json(users))


def tools_key(tools: Column) -> Column:
    """Canonical JSON of the tool definitions; null is the same as none."""
    return canonical_json_of(F.concat(F.lit("["), F.array_join(F.coalesce(tools, F.array().cast("array<string>")), ","), F.lit("]")))


def user_query(messages: Column) -> Column:
    """The user turns' texts, one per line."""
    return F.array_join(F.transform(F.filter(messages, lambda m: (m["role"] == "user") & m["content"].isNotNull()), lambda m: m["content"]), "\n")

"""Scoring of one case: predicted calls against expected calls."""

from __future__ import annotations

import re
from collections import Counter

from tessella.functions.batched import rowwise
from tessella.functions.openjson import loads
from tessella.functions.text import END, LEAK
from tessella.functions.toolcalls import parse
from tessella.schemas import SCORE

#: Fixed value: sentence signs that don't matter at the end of an argument.
TRAILING = "。.!！?？;；,，"
_LEAK = re.compile(LEAK)


def comparable(value):
    """Numbers in text as numbers, other text in lower case without final signs, lists in order of value."""
    if isinstance(value, str):
        text = value.strip().rstrip(TRAILING).strip()
        try:
            return float(text)
        except ValueError:
            return text.lower()
    if isinstance(value, list | tuple):
        items = [comparable(x) for x in value]
        try:
            return sorted(items)
        except TypeError:
            return items
    if isinstance(value, dict):
        return {k: comparable(x) for k, x in value.items()}
    return value


def _equal(have: dict, want: dict) -> int:
    return sum(comparable(have.get(k)) == comparable(v) for k, v in want.items())


def assign(expected: list[dict], predicted: list[dict]) -> list[int]:
    """For each expected call, in order, the free prediction of its name with most equal arguments (the first of ties); -1 if none."""
    free = dict(enumerate(predicted))
    out = []
    for e in expected:
        fits = [i for i, p in free.items() if p["name"] == e["name"]]
        best = max(fits, key=lambda i: (_equal(free[i]["arguments"], e["arguments"]), -i), default=-1)
        free.pop(best, None)
        out.append(best)
    return out


def clean_stop(raw: str | None, terminators: tuple[str, ...] = (END,)) -> bool:
    text = (raw or "").strip()
    return bool(text) and text.endswith(terminators) and not _LEAK.search(text)


def score(mode: str, expected: list[dict], parsed: dict, raw: str | None, terminators: tuple[str, ...] = (END,), stopped: bool | None = None) -> dict:
    """All fields of a case's score. ``stopped``: whether generation ended on a token, where that is known."""
    calls, invalid = parsed["calls"], parsed["invalid_blocks"]
    clean = clean_stop(raw, terminators) if stopped is None else stopped and not _LEAK.search((raw or "").strip())
    out = dict.fromkeys(("valid_format", "tool_selection_correct", "arg_exact_match", "invalid_json", "wrong_tool", "missing_argument", "extra_argument", "overall"), False)
    out |= {"expected_tool": mode == "tool", "expected_names": [e["name"] for e in expected], "predicted_names": [c["name"] for c in calls], "clean_stop": bool(clean), "canonical_format": None, "arg_key_accuracy": None, "no_tool_correct": None}
    if mode != "tool":
        out |= {"no_tool_correct": not calls, "overall": not calls, "wrong_tool": bool(calls), "invalid_json": bool(invalid) and not calls, "strict_protocol_success": not calls and bool(clean)}
        return out
    pairs = assign(expected, calls)
    right = -1 not in pairs and len(pairs) == len(calls) and Counter(out["expected_names"]) == Counter(out["predicted_names"])
    accuracy, exact = [], []
    for e, at in zip(expected, pairs, strict=True):
        want, have = e["arguments"], calls[at]["arguments"] if at >= 0 else {}
        missing, extra = want.keys() - have.keys(), have.keys() - want.keys()
        out["missing_argument"] |= at < 0 or bool(missing)
        out["extra_argument"] |= bool(extra)
        accuracy.append(0.0 if at < 0 else (len(want) - len(missing)) / len(want) if want else 1.0)
        exact.append(at >= 0 and not extra and _equal(have, want) == len(want))
    native = bool(calls) and all(c["source"] == "native" for c in calls)
    out |= {"valid_format": any(c["valid_json"] for c in calls), "canonical_format": native, "invalid_json": bool(invalid) or not all(c["valid_json"] for c in calls), "tool_selection_correct": right, "wrong_tool": not right, "arg_key_accuracy": sum(accuracy) / len(accuracy) if accuracy else 0.0, "arg_exact_match": bool(exact) and all(exact)}
    out["overall"] = out["valid_format"] and right and out["arg_exact_match"]
    out["strict_protocol_success"] = right and out["arg_exact_match"] and native and bool(clean)
    return out


def _loads(calls) -> list[dict]:
    """Expected calls; arguments that can't be read as an object are none."""
    return [{"name": c["name"], "arguments": _object(c["arguments"])} for c in (calls if calls is not None else [])]


def _object(text: str | None) -> dict:
    try:
        got = loads(text or "{}")
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


@rowwise(SCORE)
def score_case(mode: str | None, calls: list[dict] | None, raw: str | None, stopped: bool | None) -> dict:
    """mode and calls of what is expected, the raw text, and whether it stopped on a token (null: judge by the text)."""
    return score(mode or "tool", _loads(calls), parse(raw), raw, stopped=stopped)

"""JSON of any origin: generated text and foreign files hold what no writer of JSON would write.

Defined results. Text nested deeper than ``DEPTH`` is unreadable, as text that is no JSON is: both raise ValueError here, and
functions over columns turn that into their own result (an unreadable block, null). So no text can exhaust a worker's stack.
Halves of surrogate pairs, which UTF-8 can't hold, are read as U+FFFD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: Levels of lists and objects that are read.
DEPTH = 200

#: A whole string, also one that the text ends in, or a bracket outside of strings. Nothing is scanned twice.
_MARK = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[\[\]{}]', re.S)
_HALF = re.compile(r"\\u[dD][89a-fA-F]")
_SURROGATE = re.compile("[\ud800-\udfff]")
_SPACE = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder()


def deep_from(text: str, begin: int = 0) -> int | None:
    """Where the first value begins that is nested beyond the bound; None if there is none."""
    if text.count("[", begin) + text.count("{", begin) <= DEPTH:
        return None
    depth = top = 0
    for mark in _MARK.finditer(text, begin):
        if mark[0] in ("[", "{"):
            top = top if depth else mark.start()
            depth += 1
            if depth > DEPTH:
                return top
        elif mark[0] in ("]", "}"):
            depth = max(0, depth - 1)
    return None


def _whole(value):
    """The value without halves of surrogate pairs."""
    if isinstance(value, str):
        return _SURROGATE.sub("�", value)
    if isinstance(value, list):
        return [_whole(x) for x in value]
    if isinstance(value, dict):
        return {_whole(k): _whole(v) for k, v in value.items()}
    return value


def loads(text: str):
    """The value of a text; ValueError if it is unreadable."""
    if deep_from(text) is not None:
        raise ValueError(f"nested deeper than {DEPTH}")
    value = json.loads(text)
    return _whole(value) if _HALF.search(text) else value


def leading(text: str) -> Iterator:
    """The values of all lists and objects that a text begins with, one after the other, up to what is neither."""
    at = len(text) - len(text.lstrip(" \t\r\n"))
    if text[at : at + 1] not in ("{", "["):
        return
    deep = deep_from(text, at)
    while text[at : at + 1] in ("{", "[") and at != deep:
        try:
            value, end = _DECODER.raw_decode(text, at)
        except ValueError:
            return
        yield _whole(value) if _HALF.search(text, at, end) else value
        at = _SPACE.match(text, end).end()

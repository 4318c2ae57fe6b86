"""Settings: YAML mappings, merged, with key=value overrides. Driver side only."""

from __future__ import annotations

import ast
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from tessella.sources.files import read_file


def load(path: str | Path, root: str | Path = ".", spark: SparkSession | None = None) -> dict[str, Any]:
    """The mapping in a YAML (or JSON) file, by its path, below ``root``, below its ``configs`` folder, or there without the ending.

    With a session, in any store that Spark can read; a relative path is then one below the root.
    """
    path, root = str(path), str(root)
    whole = "://" in path or path.startswith("/")
    tries = [path] if whole else [*([] if spark else [path]), f"{root}/{path}", f"{root}/configs/{path}", f"{root}/configs/{path}.yaml"]
    text = found = None
    for found in tries:
        text = read_file(spark, found) if spark else Path(found).read_text(encoding="utf-8") if Path(found).is_file() else None
        if text is not None:
            break
    if text is None:
        raise FileNotFoundError(f"no settings at {path}")
    try:
        import yaml

        value = yaml.safe_load(text)
    except ImportError:  # JSON is YAML too
        import json

        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError(f"{found} holds no mapping")
    return value


def merged(base: dict, over: dict) -> dict:
    """A new mapping; mappings inside merge, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def overrides(items: list[str]) -> dict[str, Any]:
    """``a=1`` items; values are read as literals where they are."""
    out = {}
    for item in items:
        key, sign, value = item.partition("=")
        if not sign or not key:
            raise ValueError(f"{item} is not key=value")
        known = {"true": True, "false": False, "null": None, "none": None}
        try:
            out[key.strip()] = known[value.lower()] if value.lower() in known else ast.literal_eval(value)
        except (ValueError, SyntaxError):
            out[key.strip()] = value
    return out


def require(settings: dict, keys: list[str], name: str = "settings") -> None:
    missing = [k for k in keys if k not in settings]
    if missing:
        raise KeyError(f"{name} lacks {', '.join(missing)}")

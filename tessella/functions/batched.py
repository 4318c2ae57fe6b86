"""Functions over Arrow batches that can be declared before there is a session."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: A batch is worked on in slices of about so many bytes, and of at most so many rows.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 12
#: Results that a task keeps for inputs that come again, and the longest input of which it does, in characters.
KEPT, KEPT_CHARS = 1 << 12, 1 << 11


def batched(kind: str):
    """Make a function of pandas Series one of columns, of this SQL type."""

    def wrap(f):
        @functools.wraps(f, assigned=("__name__", "__doc__"))
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap


def _key(value) -> tuple:
    """Plain values of one row as something to look up, and their size."""
    if isinstance(value, str):
        return value, len(value)
    if isinstance(value, list | tuple | dict):
        parts = [_key(x) for x in (value.values() if isinstance(value, dict) else value)]
        return tuple(k for k, _ in parts), sum((n for _, n in parts), 1)
    return value, 1


def rowwise(kind: str):
    """Make a function of plain values, one of each column, one of columns, of this SQL type; structs are dicts. It must depend on its values only.

    Only one slice of a batch is ever there as Python objects, its results are Arrow's again before the next one is, and of
    equal rows that are short one is worked on.
    """

    def wrap(f):
        @functools.wraps(f, assigned=("__name__", "__doc__"))
        def call(*columns):
            out = to_arrow_type(DataType.fromDDL(kind))
            seen: dict = {}

            def work(*arrays: pa.Array) -> pa.Array:
                n = len(arrays[0])
                step = max(1, min(SLICE_ROWS, SLICE_BYTES * n // max(1, sum(a.nbytes for a in arrays))))
                parts = []
                for at in range(0, n, step):
                    results, place, rows = [], {}, []
                    for row in zip(*(a.slice(at, step).to_pylist() for a in arrays), strict=True):
                        key, size = _key(row)
                        if size > KEPT_CHARS:
                            rows.append(len(results))
                            results.append(f(*row))
                            continue
                        if key not in place:
                            if key not in seen:
                                if len(seen) >= KEPT:
                                    seen.clear()
                                seen[key] = f(*row)
                            place[key] = len(results)
                            results.append(seen[key])
                        rows.append(place[key])
                    made = pa.array(results, out)
                    parts.append(made if len(results) == len(rows) else made.take(pa.array(rows, pa.int64())))
                return pa.concat_arrays(parts) if parts else pa.array([], out)

            return F.arrow_udf(work, kind)(*columns)

        return call

    return wrap

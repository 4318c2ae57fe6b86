"""Joins on a key that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task takes; a key of more is dealt out. Keys that a broadcast may hold.
BOUND, KEYS = 1_000, 500_000

_PARTS, _SALT = "__tessella_parts", "__tessella_salt"


def left_join(rows: DataFrame, facts: DataFrame, key: str, count: str, by: str, bound: int = BOUND) -> DataFrame:
    """``rows`` with the facts of their key, if there are any: facts has one row a key, and ``count``, its number of rows in ``rows``,
    which isn't returned. It is read twice and so should be a written table.

    Rows of keys with more than ``bound`` of them are dealt out by a hash of the column ``by``, and their facts go to each
    part. There is one such key in ``bound`` rows at most; they are broadcast if they are few enough, else joined.
    """
    parts = F.ceil(F.col(count) / F.lit(bound)).cast("int")
    hot = facts.where(F.col(count) > bound).select(key, parts.alias(_PARTS))
    n = hot.limit(KEYS + 1).count()
    if not n:
        return rows.join(facts.drop(count), key, "left")
    left = rows.join(F.broadcast(hot) if n <= KEYS else hot, key, "left")
    left = left.withColumn(_SALT, F.coalesce(F.pmod(F.xxhash64(by), F.col(_PARTS)), F.lit(0)).cast("int")).drop(_PARTS)
    right = facts.withColumn(_SALT, F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return left.join(right, [key, _SALT], "left").drop(_SALT)

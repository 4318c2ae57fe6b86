"""The first k rows of an order, for k of any size, without a task through which all of them pass.

Rows are ordered by a key of hexadecimal digits (an md5, or a number as :func:`digits` writes it). A histogram of the keys' first
digits, made where the rows are and summed to 4,096 numbers, tells in which range the k-th row lies; the next histogram
refines that range, and so on until it holds few rows. Then all rows below the range are picked by a plain filter, and
only the range's rows are put in order. For a key that spreads, as an md5 does, that is two narrow passes for any table.

Defined results. Ties of the key are broken by ``then``; rows that are equal in all of it are exchangeable, and as many of them are picked
as are wanted. A null key comes last. k of zero or less picks nothing, k beyond the table everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import written

#: Digits that one histogram tells apart, and rows that may be put in order in one task.
DIGITS, FEW = 3, 10_000

_KEY = "__tessella_key"


def digits(number: Column) -> Column:
    """A whole number of 64 bits as 16 hexadecimal digits in its order."""
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _boundary(rows: DataFrame, k: int, few: int) -> tuple[str | None, int]:
    """The prefix of the keys among which the k-th lies, and how many of those belong to the first k; None: all rows do."""
    prefix, need = "", k
    while True:
        own = rows.where(F.col(_KEY).startswith(prefix)) if prefix else rows
        step = F.substring(_KEY, len(prefix) + 1, DIGITS)
        counts = sorted((r.d, r.n) for r in own.groupBy(step.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())  # 16 ** DIGITS rows and a few
        for d, n in counts:
            if n >= need:
                prefix += d
                if n <= few or n == need or not d:
                    return prefix, need
                break
            need -= n
        else:
            return None, 0


def first(df: DataFrame, k: int, key: Column, then: list[str] | None = None, few: int = FEW) -> DataFrame:
    """The first ``k`` rows of ``df`` by ``key`` (digits) and the columns ``then``."""
    order = [_KEY, *(then or [])]
    rows = df.withColumn(_KEY, F.coalesce(key, F.lit("~")))
    if k <= 0:
        return df.limit(0)
    if k <= few:
        return rows.orderBy(*order).limit(k).drop(_KEY)
    prefix, need = _boundary(rows, k, few)
    if prefix is None:
        return df
    below = rows.where((F.col(_KEY) < prefix) & ~F.col(_KEY).startswith(prefix))
    return below.unionByName(_some(rows.where(F.col(_KEY).startswith(prefix)), need, order, few)).drop(_KEY)


def _some(rows: DataFrame, need: int, order: list[str], few: int) -> DataFrame:
    """``need`` rows of a range: in order if it is small. A larger one has rows of one key only; if they differ in the rest
    of the order that is gone through as digits were, else any will do."""
    if rows.limit(few + 1).count() <= few:
        return rows.orderBy(*order).limit(need)
    ties = written(rows, "ties")
    if len(order) > 1 and ties.select(*order[1:]).distinct().limit(2).count() > 1:
        if dict(ties.dtypes)[order[1]] in ("bigint", "int", "smallint", "tinyint"):
            return first(ties.drop(_KEY), need, digits(F.col(order[1])), order[2:], few).withColumn(_KEY, F.lit(""))
        return ties.orderBy(*order).limit(need)
    return _any_of(ties, need)


def _any_of(rows: DataFrame, n: int) -> DataFrame:
    """Any n rows of a written table: those of its first partitions, and of one partition the first ones."""
    rows = rows.withColumn("__tessella_part", F.spark_partition_id()).withColumn("__tessella_at", F.monotonically_increasing_id())
    left, cut = n, None
    for r in sorted(rows.groupBy("__tessella_part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r[0]):
        if r.n >= left:
            cut = r[0]
            break
        left -= r.n
    if cut is None:
        return rows.drop("__tessella_part", "__tessella_at")
    part = F.col("__tessella_part")
    out = rows.where(part < cut).unionByName(rows.where(part == cut).orderBy("__tessella_at").limit(left))
    return out.drop("__tessella_part", "__tessella_at")

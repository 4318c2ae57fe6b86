"""Deterministic order, splits, samples and quota mixes. All randomness is the md5 of a seed and the row's id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators import picking


def place(seed: int, id_col: str) -> Column:
    """The row's place in a seeded shuffle, as a sort key (make it unique with the id)."""
    return F.md5(F.concat(F.lit(f"{seed}||"), F.col(id_col).cast("string")).cast("binary"))


def half_even(x: float) -> int:
    return round(x)


def numbered(df: DataFrame, seed: int, id_col: str, by: list[str] | None = None, out: str = "rk") -> DataFrame:
    """``df`` with ``out`` from 1 in shuffled order, within groups if given.

    Without groups, counts of the places' ranges give each range its first number, so that no task sorts all rows.
    """
    if by:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(place(seed, id_col), id_col)))
    at, block, before = "__tessella_place", "__tessella_block", "__tessella_before"
    marked = df.withColumn(at, place(seed, id_col)).withColumn(block, F.substring(at, 1, 3))
    sizes = marked.groupBy(block).agg(F.count(F.lit(1)).alias("n"))  # 4096 rows at most
    sizes = sizes.select(block, F.sum("n").over(W.orderBy(block).rowsBetween(W.unboundedPreceding, -1)).alias(before))
    own = F.row_number().over(W.partitionBy(block).orderBy(at, id_col))
    return marked.withColumn(out, own).join(F.broadcast(sizes), block).withColumn(out, F.col(out) + F.coalesce(before, F.lit(0))).drop(at, block, before)


_RANK = "__tessella_rank"


def split(df: DataFrame, seed: int, id_col: str, train: int | None = None, evaluate: int | None = None, share: float = 0.9) -> DataFrame:
    """``df`` with split: finite sizes take the first rows in shuffled order, else a share; rows beyond are null."""
    rows = numbered(df, seed, id_col, out=_RANK)
    if train is None:
        train = int(share * df.count())
    end = F.lit(True) if evaluate is None else F.col(_RANK) <= train + evaluate
    return rows.withColumn("split", F.when(F.col(_RANK) <= train, "train").when(end, "eval")).drop(_RANK)


def take(df: DataFrame, k: int, seed: int, id_col: str) -> DataFrame:
    """k rows without replacement (all if fewer), however many those are (``picking``)."""
    return picking.first(df, k, place(seed, id_col), [id_col])


def take_each(df: DataFrame, k: int, seed: int, id_col: str, by: list[str]) -> DataFrame:
    """k rows of each group; tasks drop what can't be among them before the shuffle."""
    return numbered(df, seed, id_col, by, _RANK).where(F.col(_RANK) <= k).drop(_RANK)


def take_fitting(df: DataFrame, k: int, size: Column, most: int, seed: int, id_col: str) -> DataFrame:
    """k rows without replacement of those whose size is at most ``most``; a null size doesn't fit. Others are dropped whole, never cut."""
    return take(df.where(F.coalesce(size <= most, F.lit(False))), k, seed, id_col)


def fitting_pool(df: DataFrame, kind: str, quotas: dict[str, int], size: Column, most: int, seed: int, id_col: str) -> DataFrame:
    """Quotas of some kinds among the rows that fit, each kind in a shuffle of its own."""
    parts = [take_fitting(df.where(F.col(kind) == name), n, size, most, seed + k, id_col) for k, (name, n) in enumerate(quotas.items())]
    return reduce(DataFrame.unionByName, parts)


def filled(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows with column draw: without replacement if there are enough; else all rows (draw 0) and more draws with replacement (draw 1, 2, ...)."""
    size = df.count()
    if size >= n:
        return take(df, n, seed, id_col).withColumn("draw", F.lit(0))
    if not size:
        return df.withColumn("draw", F.lit(0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}||draw||"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    draws = df.sparkSession.range(n - size).select((F.col("id") + 1).cast("int").alias("draw"), (F.pmod(drawn, F.lit(size)) + 1).alias(_RANK))
    rows = numbered(df.drop("draw"), seed, id_col, out=_RANK)
    return rows.withColumn("draw", F.lit(0)).drop(_RANK).unionByName(rows.join(draws, _RANK).drop(_RANK))


def targeted_mix(df: DataFrame, kind: str, total: int, parallel: float, same: float, seed: int, id_col: str) -> DataFrame:
    """A share of parallel rows, of which a share repeats names (oversampled where short), the rest ordinary (never oversampled)."""
    n_parallel = half_even(total * parallel)
    n_same = half_even(n_parallel * same)
    parts = []
    for k, (name, n) in enumerate((("parallel_same", n_same), ("parallel_diff", n_parallel - n_same))):
        if n:
            parts.append(filled(df.where(F.col(kind) == name), n, seed + k, id_col))
    picked = sum(p.count() for p in parts)
    ordinary = df.where(~F.col(kind).isin("parallel_same", "parallel_diff"))
    out = take(ordinary, max(0, total - picked), seed + 2, id_col).withColumn("draw", F.lit(0))
    for p in parts:
        out = out.unionByName(p)
    return out


def balanced_mix(df: DataFrame, kind: str, quotas: dict[str, float], total: int, seed: int, id_col: str) -> DataFrame:
    """Quotas of some kinds, the rest from all rows that weren't picked, of whatever kind."""
    parts = [filled(df.where(F.col(kind) == name), half_even(total * share), seed + k, id_col) for k, (name, share) in enumerate(quotas.items()) if half_even(total * share)]
    picked = None
    for p in parts:
        picked = p if picked is None else picked.unionByName(p)
    if picked is None:
        return take(df, total, seed, id_col).withColumn("draw", F.lit(0))
    left = df.join(picked.select(id_col).distinct(), id_col, "left_anti")
    rest = take(left, max(0, total - picked.count()), seed + len(quotas), id_col).withColumn("draw", F.lit(0))
    return picked.unionByName(rest.select(picked.columns))


def evaluation_slice(df: DataFrame, picked: DataFrame, kind: str, sizes: dict[str, int], seed: int, id_col: str, allow_picked: bool = False) -> DataFrame:
    """Rows for evaluation by kind. Rows in training are left out unless asked for."""
    pool = df if allow_picked else df.join(picked.select(id_col).distinct(), id_col, "left_anti")
    out = None
    for k, (name, n) in enumerate(sizes.items()):
        part = take(pool.where(F.col(kind) == name), n, seed + 100 + k, id_col)
        out = part if out is None else out.unionByName(part)
    return out

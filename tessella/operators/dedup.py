"""Keep-first dedup by key, and diagnostics of near-equal groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.dealing import left_join
from tessella.session import written


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """``df`` with fp and is_first: the first row of each key by the (unique) order.

    Only keys that occur more than once are joined back; their firsts are minima, pre-aggregated per task and written, and rows
    of a very common key are dealt out, so no group meets in one place. The key is evaluated for both sides: where it is dear,
    pass a column that exists.

    Defined results: a row whose key is null is no one's copy and is kept; of rows that tie in the order all the
    first ones are kept. Columns fp and is_first of ``df`` are replaced, all others stay.
    """
    marked = df.withColumn("__tessella_fp", key).withColumn("__tessella_at", F.struct(*order))
    first = marked.groupBy("__tessella_fp").agg(F.min("__tessella_at").alias("__tessella_first"), F.count(F.lit(1)).alias("__tessella_n"))
    first = written(first.where("__tessella_n > 1 and __tessella_fp is not null"), "firsts")
    joined = left_join(marked, first, "__tessella_fp", "__tessella_n", "__tessella_at")
    kept = F.col("__tessella_first").isNull() | F.col("__tessella_first").eqNullSafe(F.col("__tessella_at"))
    own = [F.col(c) for c in df.columns if c not in ("fp", "is_first")]
    return joined.select(*own, F.col("__tessella_fp").alias("fp"), kept.alias("is_first"))


def duplicate_counts(marked: DataFrame) -> DataFrame:
    """n_rows, n_kept, n_dup over a frame of :func:`keep_first`."""
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_first").alias("n_kept"), F.count_if(~F.col("is_first")).alias("n_dup"))


def same_key_different(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """key, n_values of keys that have more than one value."""
    return df.groupBy(key.alias("key")).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")

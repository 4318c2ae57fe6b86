"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import forget, written


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every v hangs from the smallest of u and its vs. The minimum is pre-aggregated per task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``links`` but the roots themselves.

    Each round is written to the shared folder. A round turns every neighbourhood into a star, so the number
    of rounds grows with the logarithm of the longest path. No node's neighbours are gathered in one place:
    only minima are. It ends when a round changes no row.

    Defined results. Links with a null end, and of a node with itself, are none; repeated links count once. An empty
    table has no components.
    """
    ab = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(ab, "links")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_smallest(large)
        down = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = small.where("u <> m").select("u", F.col("m").alias("v"))
        after = written(down.unionByName(own).distinct(), "links")
        same = after.count() == now.count() and not after.join(now, ["u", "v"], "left_anti").limit(1).count()  # both without repeats
        forget(now)
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

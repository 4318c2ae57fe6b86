"""Exact dedup with a heavy-hitter split; DataFrame functions only.

1. One pass over the texts writes a narrow table (row number, id, SHA-256).
2. A mergeable frequent-items summary (the Misra-Gries family: counters that give way under pressure) runs
   over the digests, in a tree: one summary a task, merged in ``branches`` groups, then once.
3. The candidates' true counts and winners come from a second pass over the digests, summed on the map side.
   Those with at least ``least`` rows are heavy. There are at most ``counters`` of them, so the table of
   winners has a size bound and may be broadcast; their rows never shuffle.
4. All other digests have few rows each and go through an ordinary shuffle.

Defined results. Null text counts as empty; all empty texts are one group. Of equal texts the row with the
largest id stays; null ids rank lowest. Rows that repeat an id and its text are one document more each, of
which exactly one stays. An empty table gives an empty result. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import keyed, text_of, without, written

#: Counters of a frequent-items summary, and so the bound on heavy digests (about 150 bytes each).
COUNTERS = 16_384
#: Groups in which the summaries of the tasks are merged first.
BRANCHES = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row long (unique, and fixed once written), id, text_sha256."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.sha2(text_of(text_col).cast("binary"), 256).alias("text_sha256"),
    )


def heavy_winners(marks: DataFrame, least: int = 64, counters: int = COUNTERS) -> DataFrame:
    """text_sha256, group_size, top struct(id, row) of verified frequent digests; ``counters`` rows at most."""
    summary = (
        marks.groupBy((F.spark_partition_id() % BRANCHES).alias("branch"))
        .agg(F.expr(f"approx_top_k_accumulate(text_sha256, {counters})").alias("s"))
        .groupBy(F.lit("all"))  # not a global sum: tasks without rows would hand in a null summary
        .agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s"))
    )
    likely = summary.select(F.explode(F.expr(f"approx_top_k_estimate(s, {counters})")).alias("x")).where(
        F.col("x.count") >= least
    )
    likely = likely.select(F.col("x.item").alias("text_sha256"))
    return (
        marks.join(F.broadcast(likely), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("top"))
        .where(F.col("group_size") >= least)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 64, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    marks = written(digests(docs, id_col, text_col), "digests")
    heavy = written(heavy_winners(marks, least, counters), "heavy")
    frequent = marks.join(F.broadcast(heavy), "text_sha256")
    rest = marks.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    tops = rest.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("top"))
    out = frequent.unionByName(rest.join(tops, "text_sha256"))
    return out.select(
        "row",
        "id",
        F.col("top.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The texts themselves meet only the keys that go."""
    docs = keyed(docs, id_col, nulls_last=False)
    lost = written(exact_dedup(docs, "__tessella_key", text_col).where("not kept").select(F.col("id").alias("__tessella_key")), "copies")
    return without(docs, lost)

"""What several operators of this subpackage need: shared storage, importability on workers, column hygiene."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import session
from tessella.session import shared_dir

__all__ = ["forget", "held_out", "keyed", "ready", "salted", "scratch", "shared_dir", "table", "text_of", "without", "written"]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Frames written since a :func:`scratch` began, for each one that is open.
_open: list[list[DataFrame]] = []


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from the checkout (on a cluster ship it with --py-files instead).

    Texts can be long, so Arrow batches get fewer rows than Spark's default, unless the session sets a number.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, "1500")
    session.ready(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a persisted frame this survives the loss of any executor.
    """
    out = session.written(df, name)
    if _open:
        _open[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`written` once nothing will read them again."""
    if any(df is x for x in (_open[-1] if _open else ())):
        _open[-1][:] = [x for x in _open[-1] if x is not df]
    session.forget(df)


@contextmanager
def scratch():
    """Within it, what is written is noted, and deleted at its end but for the frames given to the function it yields.

    For callers that write their own result: what operators wrote on the way is then of no use any more.
    """
    noted: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(noted)
    try:
        yield kept.append
    finally:
        _open.remove(noted)
        for df in noted:
            if not any(df is x for x in kept):
                session.forget(df)


def text_of(col: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0 (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def keyed(docs: DataFrame, id_col: str, nulls_last: bool) -> DataFrame:
    """``docs`` with ``__tessella_key``, different for every row and ordered as the id is (null ids last or first).

    Ids that repeat are told apart by a row number, for which the rows are written once; unique ids need none.
    """
    null = F.col(id_col).isNull() if nulls_last else F.col(id_col).isNotNull()
    if docs.groupBy(id_col).count().where("count > 1").limit(1).count():
        docs = written(docs.withColumn("__tessella_row", F.monotonically_increasing_id()), "rows")
    else:
        docs = docs.withColumn("__tessella_row", F.lit(0).cast("long"))
    return docs.withColumn("__tessella_key", F.struct(null.alias("n"), F.col(id_col).alias("id"), F.col("__tessella_row").alias("row"))).drop("__tessella_row")


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows of a ``keyed`` frame whose key isn't in ``lost``; columns as before."""
    lost = lost.select(F.col("__tessella_key.id").alias("__tessella_i"), F.col("__tessella_key.row").alias("__tessella_r"))
    same = F.col("__tessella_key.id").eqNullSafe(F.col("__tessella_i")) & (F.col("__tessella_key.row") == F.col("__tessella_r"))
    return docs.join(lost, same, "left_anti").drop("__tessella_key")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one key that one task of a join takes; a key of more is dealt out.
HOT_ROWS = 1_000


def salted(rows: DataFrame, facts: DataFrame, key: str, count: str, by: str, sizes: DataFrame | None = None, bound: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the one row of ``facts`` that has their key (an inner join), where a key may hold a third of all rows.

    facts: one row a key, with ``count``, its number of rows in ``rows`` (or a bound), which isn't returned. Keys of
    more than ``bound`` rows are dealt out by the column ``by``; they are at most one in ``bound`` rows, and are
    broadcast if they are few enough, else joined. They are looked for in ``sizes`` (by default the facts), which is
    read for it and so should be a table.
    """
    parts = F.ceil(F.col(count) / F.lit(bound)).cast("int")
    few = (facts if sizes is None else sizes).where(F.col(count) > bound).select(key, parts.alias("__tessella_parts"))
    n = few.limit(HOT_KEYS + 1).count()
    if not n:
        return rows.join(facts.drop(count), key)
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("__tessella_parts")), F.lit(0)).cast("int")
    left = rows.join(F.broadcast(few) if n <= HOT_KEYS else few, key, "left").withColumn("__tessella_salt", salt).drop("__tessella_parts")
    right = facts.withColumn("__tessella_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return left.join(right, [key, "__tessella_salt"]).drop("__tessella_salt")


#: Keys that a broadcast may hold.
HOT_KEYS = 500_000

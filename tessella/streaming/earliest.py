"""Keep-first dedup over a stream, by the rows' order and not by their arrival.

Event time is cut into periods. Of the rows of one key within one period the earliest by (time, order) stays. It is held
until the watermark has passed its time, as an earlier row may still come; then it is given out, its key is remembered, without
the row, until the watermark has passed the period's end, and then nothing of it is left. What comes later than the watermark
is dropped by Spark, so no row of a forgotten period comes back.

Keys are dealt into shares by their hash, and a share's rows of one period are one piece of state: a call, a timer and a few reads and
writes of state serve many keys.

A key of very many rows is thinned before the exchange: of the rows of one key and period in one Arrow batch only the earliest
goes on, which is exact, as the earliest of all is the earliest of its batch.

Defined results. Rows with a null key are no one's copies and all stay; rows without a time are dropped, as they belong to no
period. Of rows equal in time and order any one stays. All columns are carried along; ``fp``, the key, is added or
replaced. The result doesn't depend on how rows are dealt over batches, but for those later than ``wait``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

from tessella.session import ready

#: The row's time in microseconds, and its period's end in milliseconds.
_AT, _END = "__tessella_at", "__tessella_end"
#: Which share of the keys the row's belongs to.
_SHARE = "__tessella_share"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Earliest(StatefulProcessor):
    """The state of a share of the keys in one period: the earliest row of each so far, and the keys whose row was given out.

    All that a share holds is one value, read and written once a batch, and it has one timer, for the first row that falls due.
    """

    def __init__(self, columns: list[str], key: str, at: str, order: list[str]):
        self.columns, self.n = columns, len(columns)
        self.key, self.at, self.order = columns.index(key), columns.index(at), [columns.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "rows binary")

    def _load(self) -> tuple[dict, set, int | None]:
        """Rows by key, keys given out, and the timer that is set."""
        return pickle.loads(self.state.get()[0]) if self.state.exists() else ({}, set(), None)

    def _place(self, row: tuple) -> tuple:
        """Where the row stands in the order; nulls come first."""
        return tuple((row[c] is not None, row[c]) if row[c] is not None else (False, 0) for c in self.order)

    def _due(self, row: tuple) -> int:
        """The watermark at which no earlier row can come any more."""
        return -(-row[self.at] // 1000)

    def _save(self, held: dict, given: set, before: int | None, end: int) -> None:
        timer = min(map(self._due, held.values()), default=end)
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        self.state.update((pickle.dumps((held, given, timer), 5),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, given, timer = self._load()
        changed = False
        for row in rows:
            row = tuple(row)[: self.n]
            fp = row[self.key]
            if fp not in given and (fp not in held or self._place(row) < self._place(held[fp])):
                held[fp], changed = row, True
        if changed:
            self._save(held, given, timer, key[1])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, given, _ = self._load()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        out = [fp for fp, row in held.items() if self._due(row) <= now]
        rows = [held.pop(fp) for fp in out]
        given.update(out)
        if held or now < key[1]:
            self._save(held, given, None, key[1])
        else:
            self.state.clear()
        return (Row(*self.columns)(*row) for row in rows)

    def close(self) -> None:
        pass


def _thinned(by: list[str], order: list[str]):
    """Of the rows of a batch that are equal in ``by`` only the first in the order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rank = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in [*by, *order]], null_placement="at_start")
            keys = [table.column(c).combine_chunks().take(rank) for c in by]
            new = pa.array([True] * min(1, len(rank)), pa.bool_())
            if len(rank) > 1:
                differs = pc.or_(*(pc.not_equal(k.slice(1), k.slice(0, len(rank) - 1)) for k in keys))
                new = pa.concat_arrays([new, differs])
            yield batch.take(rank.filter(new))

    return work


def keep_earliest(stream: DataFrame, key: Column, time: str, *order: str, period: str = "1 day", wait: str = "1 hour", within: Column | None = None, shares: int = 1024) -> DataFrame:
    """The earliest row by (time, order) of each key within each period of event time, with its key as ``fp``.

    ``wait``: how long after a row's time earlier ones may still come. The key is a string. ``within``: the time that says
    which period a row belongs to, if it isn't the row's own, such as the time in whole seconds. It may be later than the
    row's time, and earlier by less than ``wait``. ``shares``: into how many the keys of a period are dealt; a share's rows are
    in memory at once. Like the number of shuffle partitions it is fixed for a checkpoint.
    """
    spark = stream.sparkSession
    ready(spark)
    if "rocksdb" not in spark.conf.get(_PROVIDER, "").lower():  # processors with timers need it
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = [c for c in stream.columns if c != "fp"]
    marked = stream.withColumn("fp", key.cast("string"))
    nameless = marked.where(F.col("fp").isNull() & F.col(time).isNotNull())
    rows = marked.where(F.col("fp").isNotNull() & F.col(time).isNotNull())
    within = F.col(time) if within is None else within
    end = F.unix_millis(F.window(within.cast("timestamp"), period)["end"])
    rows = rows.withColumn(_END, end).withColumn(_AT, F.unix_micros(F.col(time).cast("timestamp")))
    # Python's times have no zone of their own: the columns of this type travel as numbers.
    times = [f.name for f in rows.schema if isinstance(f.dataType, TimestampType)]
    rows = rows.withColumns({c: F.unix_micros(c) for c in times})
    place = [_AT, *order]
    thin = rows.mapInArrow(_thinned(["fp", _END], place), rows.schema)
    kept = StructType([StructField(f.name, f.dataType, True) for f in rows.schema if f.name != _END])
    waiting = thin.withColumn("__tessella_time", F.timestamp_micros(_AT)).withWatermark("__tessella_time", wait)
    dealt = waiting.select(*kept.names, F.pmod(F.hash("fp"), F.lit(shares)).alias(_SHARE), _END, "__tessella_time")
    out = dealt.groupBy(_SHARE, _END).transformWithState(Earliest(kept.names, "fp", _AT, place), kept, "append", "EventTime")
    out = out.withColumns({c: F.timestamp_micros(c) for c in times})
    return out.select(*columns, "fp").unionByName(nameless.select(*columns, "fp"))

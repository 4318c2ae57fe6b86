"""Streams written as files, each batch into a folder of its own, so that a replay writes nothing twice.

A batch that failed, or whose success was not noted before the driver was lost, is run again with the same number and
the same input. It then overwrites its own folder, and no other. Readers take only folders that were written to the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessella.sources import files

_DONE = "_SUCCESS"


def batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch:012d}"


def write_jsonl_batch(batch: DataFrame, path: str) -> None:
    """One batch as JSON lines in UTF-8, nulls kept, in place of what a failed run left there."""
    batch.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_batches(stream: DataFrame, path: str, checkpoint: str, write: Callable[[DataFrame, str], None] = write_jsonl_batch, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Start writing a stream to the end of what there is; ``checkpoint`` is a folder that all machines share."""

    def each(batch: DataFrame, number: int) -> None:
        write(batch, batch_path(path, number))

    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()


def whole_batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of batches that were written to the end, in order."""
    try:
        found = files.listed(spark, path)
    except Exception as e:  # no batch was written yet
        if "FileNotFound" in str(e):
            return []
        raise
    return sorted(x.rsplit("/", 1)[0] for x in found if x.rsplit("/", 1)[1] == _DONE)


def read_batches(spark: SparkSession, path: str, schema: str, format: str = "json") -> DataFrame:
    """The rows of all whole batches, with the number of each as ``batch``."""
    got = whole_batches(spark, path)
    if not got:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    out = spark.read.schema(f"{schema}, batch bigint").option("basePath", path).format(format)
    return out.load(got)

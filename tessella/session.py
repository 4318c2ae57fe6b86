"""Session helpers: importability on workers, and tables in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What an Arrow batch may hold, so that a Python worker's memory doesn't grow with the rows' length.
_BATCH_BYTES, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from the checkout (on a cluster ship it with --py-files instead).

    Each worker is one task's, so its matrix products take one core. Arrow batches get few bytes, unless the session sets a number.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(_BYTES))
    env = spark.sparkContext.environment
    env.setdefault("OMP_NUM_THREADS", "1")
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Unset, a folder is made where the driver is
    the only machine; on a cluster that is an error, as executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a persisted frame this survives the loss of any executor. The shuffle files of the writing go with it: what
    is written needs them no more, and they would else stay until the driver's memory fills.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`written` once nothing will read them again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for one in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if "/tessella/" in one:
            path = jvm.org.apache.hadoop.fs.Path(one)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

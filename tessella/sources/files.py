"""Reading and writing: JSON lines, local mirrors, documents, and the guard on paths."""

from __future__ import annotations

import json
import posixpath
import time
from collections import Counter
from collections.abc import Callable
from functools import reduce
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators import picking

# File endings and the reader of each.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


def inside(root: str | Path, path: str | Path) -> Path:
    """The absolute path, which must lie inside ``root``."""
    root = Path(root).resolve()
    out = (Path(path) if Path(path).is_absolute() else root / path).resolve()
    if out != root and root not in out.parents:
        raise ValueError(f"{path} lies outside {root}")
    return out


def inside_store(root: str, path: str) -> str:
    """The same for paths of any store: a path, whole or relative, that must lie inside ``root``. Links aren't followed."""
    scheme, sign, place = root.partition("://")
    base = posixpath.normpath(place if sign else root)
    given = path.partition("://")[2] if sign and path.startswith(f"{scheme}://") else path
    whole = given if posixpath.isabs(given) or path != given else posixpath.join(base, given)
    out = posixpath.normpath(whole)
    if "://" in given or (out != base and not out.startswith(base.rstrip("/") + "/")):
        raise ValueError(f"{path} lies outside {root}")
    return f"{scheme}://{out}" if sign else out


def inside_column(path: Column) -> Column:
    """A relative path without empty steps, dots and steps back; null where it is null, absolute, of a store, or leaves its root."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    # The steps so far; null once a step back leads out.
    walked = F.aggregate(steps, none, lambda at, x: F.when(x != "..", F.concat(at, F.array(x))).when(F.size(at) > 0, F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))))
    return F.when(~path.startswith("/") & ~path.contains("://"), F.array_join(walked, "/"))


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small text file of any store that Spark can read; None if there is none."""
    at, fs = _store(spark, path)
    if not fs.exists(at) or not fs.getFileStatus(at).isFile():
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Typed rows of JSON lines. Blank lines are skipped; a line that is no JSON object of the schema is an error when read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line_no-free raw rows: file, value (a JSON object as text). Lines that are no object raise an error."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    good = F.schema_of_variant(F.parse_json("value")).startswith("OBJECT")
    return lines.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))).cast("string")))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no (from 0), value of every line, however the files are split for reading.

    A line's number is its place in its block of the file and the sizes of the blocks before; blocks are counted
    where they are read, and only these counts (one row a block) are put in order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("read"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("read").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # A task reads a block's lines one after the other, so the numbers of one block have no gaps.
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("read") - F.col("first")).alias("line_no"), "value")


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines in UTF-8, nulls kept, overwriting. ``one_file`` is for small results only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _store(spark: SparkSession, path: str):
    """A path of any store that Spark can write, and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_jsonl_file(df: DataFrame, path: str) -> None:
    """A small result as one file of JSON lines with this name, overwriting."""
    spark = df.sparkSession
    parts = f"{path}.parts"
    write_jsonl(df, parts, one_file=True)
    to, fs = _store(spark, path)
    fs.delete(to, False)
    part = next(x for x in listed(spark, parts) if PurePosixPath(x).name.startswith("part-"))
    fs.rename(_store(spark, part)[0], to)
    fs.delete(_store(spark, parts)[0], True)


def write_jsonl_files(df: DataFrame, root: str, name: str) -> None:
    """A result of any size as files of JSON lines that all have this name, each in a folder of its own below ``root``. Every partition of the frame writes one."""
    spark = df.sparkSession
    parts = f"{root}.parts"
    write_jsonl(df, parts)
    for k, part in enumerate(sorted(x for x in listed(spark, parts) if PurePosixPath(x).name.startswith("part-"))):
        to, fs = _store(spark, f"{root}/{k:05d}/{name}")
        fs.mkdirs(to.getParent())
        fs.delete(to, False)
        if not fs.rename(_store(spark, part)[0], to):
            raise OSError(f"{part} could not be named {to}")
    at, fs = _store(spark, parts)
    fs.delete(at, True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file of any store that Spark can write, overwriting."""
    at, fs = _store(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def capped(df: DataFrame, cap: int | None, order: str | None = None) -> DataFrame:
    """The first rows (in an order, if given); None: all. By a whole number, the cap may be of any size (``picking``)."""
    if cap is None:
        return df
    if order and dict(df.dtypes)[order] in ("bigint", "int", "smallint", "tinyint"):
        return picking.first(df, cap, picking.digits(F.col(order)))
    return (df.orderBy(order) if order else df).limit(cap)


def most_common_format(names: list[str]) -> tuple[str, list[str]]:
    """The reader and the sorted files of the file ending that occurs most; endings without a reader don't count."""
    known = [x for x in names if PurePosixPath(x).suffix in FORMATS]
    if not known:
        raise FileNotFoundError("no data files")
    best = Counter(PurePosixPath(x).suffix for x in known).most_common(1)[0][0]
    return FORMATS[best], sorted(x for x in known if PurePosixPath(x).suffix == best)


def listed(spark: SparkSession, root: str) -> list[str]:
    """All files below a folder of any store that Spark can read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listFiles(path, True)
    out = []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def read_mirror(spark: SparkSession, root: str, split: str | None = None, union: bool = False) -> DataFrame:
    """The data files below a folder.

    split: only files called eval.jsonl (for ``test``) or train.jsonl. union: exports of differing columns are
    united by name, missing columns null. JSON and Parquet are read at once, their schemas merged; CSV files, whose
    columns are only named by their first lines, are read by groups of equal headers.
    """
    names = listed(spark, root)
    if split is not None:
        want = "eval.jsonl" if split == "test" else "train.jsonl"
        names = [x for x in names if PurePosixPath(x).name == want]
    kind, files = most_common_format(names)
    if kind != "csv":
        return spark.read.option("mergeSchema", str(union).lower()).format(kind).load(files)
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    if not union:
        return reader.csv(files)
    headers: dict[tuple, list[str]] = {}
    for f in files:
        headers.setdefault(tuple(reader.csv(f).columns), []).append(f)
    parts = [reader.csv(group) for group in headers.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def loaded(local: Callable[[], DataFrame], remote: Callable[[], DataFrame] | None = None, attempts: int = 3, wait: float = 3.0) -> DataFrame:
    """The local mirror if there is one, else the remote source, tried several times with growing pauses."""
    try:
        return local()
    except FileNotFoundError:
        if remote is None:
            raise
    except Exception as e:  # Spark names missing paths in its own way
        if remote is None or "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
    for k in range(attempts):
        try:
            return remote()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * (k + 1))
    raise ValueError("attempts must be positive")


def concat_benchmarks(parts: dict[str, DataFrame]) -> DataFrame:
    """Benchmarks in one frame; rows that name no source get their file's name."""
    out = None
    for name, df in parts.items():
        have = F.col("benchmark_source") if "benchmark_source" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("benchmark_source", F.coalesce(have, F.lit(name)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_document(value: dict, path: str | Path, spark: SparkSession | None = None) -> None:
    """A small report as one JSON document; with a session, in any store that Spark can write."""
    text = json.dumps(value, ensure_ascii=False, indent=2)
    if spark is not None:
        write_text(spark, text, str(path))
        return
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def report(df: DataFrame) -> dict:
    """A one-row frame as a dict."""
    row = df.first()
    return {} if row is None else row.asDict(recursive=True)

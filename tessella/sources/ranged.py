"""Lines of files in byte ranges, read where they are needed, with retries there.

A Python data source: the driver only lists files and cuts them into ranges; a task reads neighbouring ranges, ``task`` bytes together, one after the other. A line belongs to the range in
which it begins, so ranges of any size give every line once. A read that fails goes on at the last whole line that was
handed over, after a pause that grows with each failure in a row; only after ``attempts`` of those the task fails, and
Spark's own retry begins. Memory is one chunk of ``batch`` bytes and the longest line.

Columns: file, start (the line's first byte, which with the file tells every line apart, however the files are cut), value
(the line without its end; UTF-8, what isn't becomes U+FFFD). A last line without an end counts, an empty file has none.
Paths are those of any store that Arrow can open (a local path, file://, hdfs://, s3://); folders are read with all below
them, but for names that begin with _ or a dot.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.session import ready

_ROWS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("value", pa.string())])


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class Task(InputPartition):
    ranges: list[Range]


class LinesReader(DataSourceReader):
    """Options: path (several: one a line), split, batch and task (bytes), attempts, wait (seconds)."""

    def __init__(self, options):
        get = lambda name, default: type(default)(options.get(name, default))
        self.paths = [p for p in options.get("path", "").split("\n") if p]
        self.split, self.batch = max(1, get("split", 64 << 20)), max(1, get("batch", 4 << 20))
        self.task = get("task", 32 << 20)
        self.attempts, self.wait = max(1, get("attempts", 3)), get("wait", 3.0)

    def partitions(self) -> list[Task]:
        out: list[Range] = []
        for given in self.paths:
            for info, shown in self._files(given):
                out += [Range(shown, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]
        tasks, size = [Task([])], 0
        for x in out:
            if tasks[-1].ranges and size + x.end - x.begin > self.task:
                tasks.append(Task([]))
                size = 0
            tasks[-1].ranges.append(x)
            size += x.end - x.begin
        return tasks

    def _files(self, path: str) -> list[tuple[store.FileInfo, str]]:
        fs, at = store.FileSystem.from_uri(path) if "://" in path else (store.LocalFileSystem(), path)
        one = fs.get_file_info(at)
        if one.type == store.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [one] if one.is_file else [x for x in fs.get_file_info(store.FileSelector(at, recursive=True)) if x.is_file]
        below = lambda x: x.path[len(at) :].split("/") if not one.is_file else [""]
        return [(x, path[: len(path) - len(at)] + x.path if path.endswith(at) else x.path) for x in sorted(found, key=lambda x: x.path) if not any(p[:1] in ("_", ".") for p in below(x))]

    def opened(self, path: str, at: int):
        """A stream of the file's bytes from a place on."""
        fs, inner = store.FileSystem.from_uri(path) if "://" in path else (store.LocalFileSystem(), path)
        f = fs.open_input_file(inner)
        f.seek(at)
        return f

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self.range(one)

    def range(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.begin >= partition.end:
            return
        at, skip = partition.begin, partition.begin > 0
        if skip:
            at -= 1  # the line that begins here does so after an end in the byte before
        failures = 0
        while True:
            try:
                for lines, at, skip in self._lines(partition, at, skip):
                    failures = 0
                    if lines:
                        yield pa.RecordBatch.from_pydict({"file": [partition.path] * len(lines), "start": [s for s, _ in lines], "value": [v.decode("utf-8", "replace") for _, v in lines]}, schema=_ROWS)
                return
            except OSError:
                failures += 1
                if failures >= self.attempts:
                    raise
                time.sleep(self.wait * failures)

    def _lines(self, partition: Range, at: int, skip: bool) -> Iterator[tuple[list[tuple[int, bytes]], int, bool]]:
        """Lines chunk by chunk, with the place after them, from which reading can go on. skip: up to the first end is another range's."""
        stream = self.opened(partition.path, at)
        try:
            rest: list[bytes] = []  # of a line without its end yet; at: where it begins
            while True:
                chunk = stream.read(self.batch)
                last = not chunk
                if not last and b"\n" not in chunk:
                    rest.append(bytes(chunk))
                    continue
                data = b"".join([*rest, bytes(chunk)])
                lines = data.split(b"\n")
                tail = lines.pop()
                out = []
                for line in lines:
                    if at >= partition.end:
                        break
                    if not skip:
                        out.append((at, line.removesuffix(b"\r")))
                    skip = False
                    at += len(line) + 1
                else:
                    if last and tail and not skip and at < partition.end:
                        out.append((at, tail.removesuffix(b"\r")))
                        at += len(tail)
                yield out, at, skip
                if last or at >= partition.end:
                    return
                rest = [tail]
        finally:
            stream.close()


class Lines(DataSource):
    """Registered as ``ranged_lines``."""

    @classmethod
    def name(cls) -> str:
        return "ranged_lines"

    def schema(self) -> str:
        return "file string, start bigint, value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def read_lines(spark: SparkSession, path: str | list[str], source: type[DataSource] = Lines, **options) -> DataFrame:
    """file, start, value of every line. Options as of :class:`LinesReader`."""
    ready(spark)
    spark.dataSource.register(source)
    paths = "\n".join([path] if isinstance(path, str) else path)
    return spark.read.format(source.name()).options(path=paths, **{k: str(v) for k, v in options.items()}).load()


def read_objects(spark: SparkSession, path: str | list[str], schema: str, source: type[DataSource] = Lines, **options) -> DataFrame:
    """JSON lines as typed rows with file and start. Blank lines are skipped; a line that is no JSON of the schema is an error when read."""
    lines = read_lines(spark, path, source, **options).where(F.trim(F.regexp_replace("value", r"(?U)\s", "")) != "")
    return lines.select("file", "start", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("__tessella_row")).select("file", "start", "__tessella_row.*")

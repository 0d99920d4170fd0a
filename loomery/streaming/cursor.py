"""Growing log files as a stream: a cursor of byte offsets bound to each file's identity.

Only complete lines are read. A file that was replaced (another inode) is read from its start; one that was cut short goes on from its new end,
so nothing is replayed. The offset of a batch holds a small entry for each file of the folder; large ranges are split for tasks, each of which begins
at the first line that starts in its part.

Growing files live on file systems: the folder must be mounted under the same path on the driver and all executors (stores of immutable objects
have no growing files; for those ``streams.records`` reads closed ones). If the driver restarts between a cut and the next batch, the line
that the cut parted is read from its start.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, line string"
#: Bytes of a task's part, of a look back for the last line's end, and rows of a batch.
PART, BLOCK, ROWS = 64 << 20, 1 << 16, 10_000


def local_path(path: str) -> str:
    """A mounted folder's plain path."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"{path}: growing files are read from a mounted folder")
    return plain


def lines_end(path: str, size: int) -> int:
    """Offset behind the last line's end among the first ``size`` bytes; reads back from there only."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            low = max(0, at - BLOCK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    stop: int
    first: bool


class CursorReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.pattern, self.part = local_path(options["path"]), options.get("pattern", "*"), int(options.get("partbytes", PART))
        self.floors: dict[str, int] = {}  # where a cut file goes on

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for name in sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else []:
            path = os.path.join(self.folder, name)
            try:
                info = os.stat(path)
                if fnmatch.fnmatch(name, self.pattern) and os.path.isfile(path):
                    found[name] = {"bytes": max(lines_end(path, info.st_size), min(self.floors.get(name, 0), info.st_size)), "id": f"{info.st_dev}:{info.st_ino}"}
            except FileNotFoundError:  # gone meanwhile
                continue
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for name, to in end.items():
            was, path = start.get(name), os.path.join(self.folder, name)
            same = was is not None and was["id"] == to["id"]
            if not same:
                self.floors.pop(name, None)
            begin = was["bytes"] if same else 0
            if begin > to["bytes"]:
                self.floors[name] = os.stat(path).st_size if os.path.exists(path) else to["bytes"]
                continue
            begin = max(begin, min(self.floors.get(name, 0), to["bytes"]))
            parts += [Part(path, at, min(to["bytes"], at + self.part), at == begin) for at in range(begin, to["bytes"], self.part)]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names, places, lines = [], [], []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])
        with open(partition.path, "rb") as f:
            at = partition.begin
            if not partition.first:  # the line that begins before belongs to the part before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.stop and (raw := f.readline()):
                text = raw.rstrip(b"\r\n").decode("utf-8", "replace")
                if text.strip():
                    names.append(os.path.basename(partition.path))
                    places.append(at)
                    lines.append(text)
                at += len(raw)
                if len(lines) >= ROWS:
                    yield pack()
                    names, places, lines = [], [], []
        if lines:
            yield pack()


class CursorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CursorReader:  # noqa: ANN001
        return CursorReader(self.options)


def growing_lines(spark: SparkSession, folder: str, pattern: str = "*", part_bytes: int = PART) -> DataFrame:
    """(file, at, line): the complete, non-blank lines of a folder's growing files, as they are appended."""
    spark.dataSource.register(CursorSource)
    return spark.readStream.format("growing_lines").option("path", folder).option("pattern", pattern).option("partBytes", str(part_bytes)).load()


def growing_records(spark: SparkSession, folder: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """The JSON records of growing files, with their file and place; lines that are no object are skipped."""
    lines = growing_lines(spark, folder, pattern)
    return lines.filter(F.startswith(F.trim("line"), F.lit("{"))).withColumn("r", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})).filter("r is not null and r._bad is null").select("file", "at", "r.*").drop("_bad")

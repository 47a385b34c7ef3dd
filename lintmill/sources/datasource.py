"""A data source for folders of analyzer output that keeps each line's number: ``spark.read.format("analyzer_output").load(root)``, and the same with readStream.

Spark's text source, as ``folders.tool_lines`` uses it, reads from more stores and splits large files, but knows no line numbers, and the input order of findings
decides which of several equal ones stays. Here every file is a partition, read line by line by itself; columns that a given schema leaves out
are not made. A stream's offset is the time of the newest file it has taken, in nanoseconds, so files must appear whole, as renaming makes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "analyzer_output"
#: What a file's place ``repo/side/source.anything`` and its lines give.
SCHEMA = "repo string, side string, source string, path string, line_no bigint, value string"
BATCH_LINES = 8192


@dataclass
class File(InputPartition):
    root: str
    path: str


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(quote(root, safe=":/?&=@%+,")) if re.match(r"[a-z][a-z0-9+.-]*://", root) else (fs.LocalFileSystem(), root)
    return system, path.rstrip("/")


def _listed(root: str) -> list[tuple[int, str]]:
    """(time, path) of the files two folders below the root."""
    system, base = _opened(root)
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((x.mtime_ns or 0, x.path) for x in found if x.type == fs.FileType.File and x.path[len(base) + 1 :].count("/") == 2)


class _Lines:
    """What batch and stream share: the lines of one file as record batches of the asked columns."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("load needs a path")
        self.root, self.names = options["path"], schema.fieldNames()

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, base = _opened(partition.root)
        place = partition.path[len(base) + 1 :]
        repo, side, file = place.split("/")
        fixed = {"repo": repo, "side": side, "source": file.partition(".")[0], "path": place}

        def batch(first: int, lines: list[bytes]) -> pa.RecordBatch:
            made = {"line_no": lambda: pa.array(range(first, first + len(lines)), pa.int64()), "value": lambda: pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())}
            columns = [made[n]() if n in made else pa.array([fixed[n]] * len(lines), pa.string()) for n in self.names]
            return pa.RecordBatch.from_arrays(columns, names=self.names)

        with system.open_input_stream(partition.path) as raw:  # unpacked by its extension
            first, held, rest = 1, [], b""
            while block := raw.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                held += lines
                while len(held) >= BATCH_LINES:
                    yield batch(first, held[:BATCH_LINES])
                    first, held = first + BATCH_LINES, held[BATCH_LINES:]
            held += [rest] if rest else []
            if held:
                yield batch(first, held)


class _Reader(_Lines, DataSourceReader):
    def partitions(self) -> Sequence[File]:
        return [File(self.root, path) for _, path in _listed(self.root)]


class _StreamReader(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802  named by Spark
        return {"newest": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"newest": max((time for time, _ in _listed(self.root)), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[File]:
        return [File(self.root, path) for time, path in _listed(self.root) if start["newest"] < time <= end["newest"]]


class AnalyzerOutput(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(AnalyzerOutput)

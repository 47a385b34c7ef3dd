"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.sources.store import forget, shared_folder, written

__all__ = ["binaries", "collected", "forget", "fresh", "let", "mapped", "schema_with", "shared_folder", "slices", "spread_join", "table", "written"]

#: What one batch between the JVM and a Python worker may hold; a longer text comes by itself.
BATCH_BYTES = 8 << 20
#: A key is hot if it has more than one in HOT_SHARE of all rows, and HOT_ROWS at least.
HOT_SHARE, HOT_ROWS = 1000, 100
#: ASCII white space: what separates words in every contract of this package.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside a row, so that ``body`` can use it many times without evaluating it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _give_back() -> None:
    """Return a worker's free memory to the system: an idle worker is kept for the next task and counts as long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_BYTES``, by workers that give their memory back at a task's end."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(str(conf.get(name)).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], total: int, size: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with one row per key of ``groups``, whose ``size`` is a key's share of the ``total`` rows.

    Keys of over a thousandth of all rows, of which there can't be more than a thousand, are broadcast; so no task gets more than
    that of one key. Both inputs are read twice and should be cheap to read. how: inner or left.
    """
    bound = max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = F.broadcast(groups.where(F.col(size) > bound)), groups.where(F.col(size) <= bound)
    return rows.join(hot, on, "inner").unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on, how))


def collected(spark: SparkSession) -> None:
    """Let the driver drop what finished steps no longer need; the files of their shuffles go with it."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def binaries(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null as None."""
    return column.cast(pa.binary()).to_pylist()


def slices(texts: Iterable[bytes | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together, one text at least."""
    start = size = 0
    end = 0
    for end, text in enumerate(texts, 1):
        size += len(text or b"") + 8
        if size >= limit:
            yield start, end
            start, size = end, 0
    if end > start:
        yield start, end


def schema_with(df: DataFrame, extra: str) -> T.StructType:
    """The columns of ``df`` and those of a DDL string."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(extra).fields])

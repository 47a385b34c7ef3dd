"""Isotonic calibration of scores by pooling adjacent violators, over tasks that each hold a part of the order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.operators.order import carried, numbered
from lintmill.sources.store import forget, written

#: Pools that one task takes at a time.
POOLS = 1 << 20
_POOL = "lo double, hi double, n bigint, total double"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge neighbours whose means do not rise; pools come in order. Adjacent pools may be merged in any order, the result is the same."""
    lo, hi, n, total = [], [], [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b, count, own = row
            while n and total[-1] * count >= own * n[-1]:
                a, count, own = lo.pop(), count + n.pop(), own + total.pop()
                hi.pop()
            lo.append(a)
            hi.append(b)
            n.append(count)
            total.append(own)
    yield pa.RecordBatch.from_arrays([pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["lo", "hi", "n", "total"])


def isotonic(points: DataFrame, pools_per_task: int = POOLS) -> DataFrame:
    """(lo, hi, n, total, value): the pools of the rising step function that fits (score, y) best in squares, values strictly rising.

    Rows of one score are one pool from the start. Each round deals the pools, in order, to tasks of ``pools_per_task`` and merges within each; the next
    round's tasks begin half a task later, so that the last round's borders lie inside, until the pools fit one task or no two that meet at a
    border break the order. Sums of labels that are whole numbers are exact. Rows with a null score or label are left out.
    """
    rows = points.where("score is not null and y is not null and not isnan(cast(score as double))")
    pools = rows.groupBy(F.col("score").cast("double").alias("lo")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("total")).select("lo", F.col("lo").alias("hi"), "n", "total")
    shift = 0
    while True:
        placed = numbered(pools, "lo")
        count = placed.count()
        one = count <= pools_per_task
        task = F.lit(0) if one else F.floor((F.col("place") - 1 + shift) / pools_per_task).cast("int")
        tasks = 1 if one else (count - 1 + shift) // pools_per_task + 1
        dealt = placed.withColumn("task", task).repartitionById(tasks, F.col("task")).sortWithinPartitions("place").select("lo", "hi", "n", "total")
        new = written(dealt.mapInArrow(_pooled, _POOL).withColumn("task", F.spark_partition_id()), "pools")
        forget(pools)
        ends = [] if one else new.groupBy("task").agg(F.min_by(F.struct("n", "total"), "lo").alias("first"), F.max_by(F.struct("n", "total"), "lo").alias("last")).orderBy("task").collect()  # a row per task
        pools = new.drop("task")
        if all(a["last"]["total"] * b["first"]["n"] < b["first"]["total"] * a["last"]["n"] for a, b in zip(ends, ends[1:], strict=False)):
            return pools.withColumn("value", F.col("total") / F.col("n"))
        shift = pools_per_task // 2 - shift


def calibrated(rows: DataFrame, pools: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
    """``rows`` with the value of the pool that each score lies in, or of the nearest one below; scores below the first pool have the first value.

    Different scores and the pools' lower ends are put into one order and values carried forward, so nothing is compared range by range. A null score stays null.
    """
    key = F.col(f"`{score}`").cast("double")
    scores = rows.where(key.isNotNull()).select(key.alias("lo")).distinct().select("lo", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("value"))
    marks = pools.select("lo", F.lit(0).alias("kind"), "value")
    least = pools.agg(F.min("value")).first()[0]
    found = carried(marks.union(scores), "value", "lo", "kind").where("kind = 1")
    found = found.select(F.col("lo").alias("__score"), F.coalesce("latest", F.lit(least).cast("double")).alias(name))
    return rows.join(found, key == F.col("__score"), "left").drop("__score")

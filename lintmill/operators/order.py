"""Places in a total order without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.sources.store import forget, written

_BITS = 33  # of monotonically_increasing_id, for the row in its partition


def numbered(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1 on, in the order of the given columns; rows that agree in all of them are numbered in any order.

    Range partitions are sorted each by itself and written with the row's number there; what the driver then adds is one count per partition.
    """
    whole = written(rows, "order-input")
    raw = f"__raw_{name}"
    spread = written(whole.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(raw, F.monotonically_increasing_id()), "order")
    forget(whole)
    part = F.shiftright(raw, _BITS)
    counts = spread.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).collect()  # a row per partition
    before, offsets = 0, {}
    for row in sorted(counts, key=lambda r: r["part"]):
        offsets[row["part"]], before = before, before + row["n"]
    first = F.get(F.split(F.lit(",".join(str(offsets.get(p, 0)) for p in range(max(offsets, default=0) + 1))), ",").cast("array<bigint>"), part.cast("int"))
    return spread.withColumn(name, first + F.col(raw).bitwiseAND((1 << _BITS) - 1) + 1).drop(raw)


def numbered_within(rows: DataFrame, keys: tuple[str, ...], *order: str | Column, name: str = "place") -> DataFrame:
    """``rows`` with their place among those that share ``keys``; a key may have any part of all rows."""
    out = numbered(rows, *keys, *order, name=name)
    first = out.groupBy(*keys).agg(F.min(name).alias("__first"))
    return out.join(first, list(keys)).withColumn(name, F.col(name) - F.col("__first") + 1).drop("__first")


def carried(rows: DataFrame, value: str, *order: str | Column, name: str = "latest") -> DataFrame:
    """``rows`` with the latest value of a column that is not null, at each row or before it in the order; null before the first.

    An as-of join is this over both of its sides together. Range partitions are sorted and written as in ``numbered``; the driver adds the last value of each.
    """
    whole = written(rows, "order-input")
    spread = written(whole.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__raw", F.monotonically_increasing_id()), "order")
    forget(whole)
    part = F.shiftright("__raw", _BITS).cast("int")
    last = spread.where(F.col(f"`{value}`").isNotNull()).groupBy(part.alias("part")).agg(F.max_by(value, "__raw").alias("last")).collect()  # a row per partition
    known, before = {r["part"]: r["last"] for r in last}, [None]
    for p in range(max(known, default=0) + 1):
        before.append(known.get(p, before[-1]))
    kind = rows.schema[value].dataType
    above = F.get(F.array(*(F.lit(x).cast(kind) for x in before)), F.least(part, F.lit(len(before) - 1)))
    here = F.last(value, ignorenulls=True).over(W.partitionBy("__part").orderBy("__raw").rowsBetween(W.unboundedPreceding, W.currentRow))
    return spread.withColumn("__part", part).withColumn(name, F.coalesce(here, above)).drop("__raw", "__part")


#: Rows of a group that one task may sort.
SORTED_ROWS = 10_000


def least_by_digest(rows: DataFrame, keys: tuple[str, ...], limits: DataFrame, digest: Column, *order: str | Column, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The first rows of each group by (``digest``, ``order``), as many as ``limits`` (keys, most) says, without a sort of any group.

    ``digest`` is hexadecimal, so evenly spread. Rows are counted by group and by two more of its digits, which adds up before the shuffle; the digits at
    which a group's limit lies are counted on, two by two, until no more than ``sorted_rows`` rows have the same ones, and only those are sorted.
    """
    own = rows.withColumn("__digest", digest)
    cut = written(limits.where("most > 0").select(*keys, F.lit("").alias("__cut"), F.col("most").cast("bigint").alias("__left")), "cut")
    for width in range(2, 65, 2):
        within = own.join(cut, list(keys)).where(F.col("__digest").startswith(F.col("__cut")))
        counts = within.groupBy(*keys, "__left", F.substring("__digest", 1, width).alias("__cut")).agg(F.count("*").alias("n"))
        above = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at most 256 rows of a group
        found = counts.withColumn("__above", above).where(F.col("__above") < F.col("__left"))
        last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__cut")))
        cut = written(found.withColumn("__n", last).where("__n = 1").select(*keys, "__cut", (F.col("__left") - F.col("__above")).alias("__left"), "n"), "cut")
        if (cut.agg(F.max("n")).first()[0] or 0) <= sorted_rows:
            break
    joined = own.join(cut.drop("n"), list(keys))
    same = F.col("__digest").startswith(F.col("__cut"))
    before = joined.where(~same & (F.col("__digest") < F.col("__cut")))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("__digest", *order))
    border = joined.where(same).withColumn("__n", place).where(F.col("__n") <= F.col("__left")).drop("__n")
    return before.unionByName(border).select(*(F.col(f"`{c}`") for c in rows.columns))

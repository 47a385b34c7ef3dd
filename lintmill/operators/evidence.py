"""Context packing, evidence ladder and publishing gate."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintmill.functions import rules as R
from lintmill.sources.store import written


def _taken(budget: int):
    """Over rows (group, id, tokens) in order: those that still fit, with their place in the group. What is carried from batch to batch is the group and what it has used."""

    def run(batches):
        key, used, place = None, 0, 0
        for batch in batches:
            groups, tokens = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            take, places = [], []
            for i, (group, t) in enumerate(zip(groups, tokens, strict=True)):
                if (group,) != key:
                    key, used, place = (group,), 0, 0
                if used + t <= budget:
                    take.append(i)
                    places.append(place)
                    used, place = used + t, place + 1
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(take, pa.int64())) for c in batch.columns), pa.array(places, pa.int32())], names=[*batch.schema.names, "place"])

    return run


def packed(units: DataFrame, budget: int, key: str = "grp") -> DataFrame:
    """Units (key, id, seq, priority, tokens, text) that fit a token budget: by priority, then input order; one that doesn't fit is skipped.

    A fold in order with what is used so far as its state, since a running sum would give another result. Groups are sorted and streamed, so a group
    may have any number of units; a unit that is over the whole budget is counted and not sorted. A group's row of totals stays if nothing fits.
    """
    tokens = F.when(F.col("tokens") == 0, R.token_estimate(F.col("text"))).otherwise(F.col("tokens"))
    rows = units.select(key, "id", tokens.cast("bigint").alias("t"), (-F.col("priority")).alias("p"), "seq")
    fits = rows.where(F.col("t") <= budget).repartition(key).sortWithinPartitions(key, "p", "seq", "id", "t").select(key, "id", "t")
    schema = T.StructType([*fits.schema.fields, T.StructField("place", T.IntegerType())])
    taken = written(fits.mapInArrow(_taken(budget), schema), "packed")
    totals = taken.groupBy(key).agg(F.sum("t").alias("tokens"), F.count("*").alias("__taken"))
    totals = units.groupBy(key).agg(F.count("*").alias("__n")).join(totals, key, "left")
    totals = totals.select(key, F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("__n") - F.coalesce("__taken", F.lit(0))).cast("int").alias("dropped"))
    return totals.join(taken.select(key, "place", "id"), key, "left").select(key, "tokens", "dropped", "place", "id")


def rendered(pack: DataFrame, units: DataFrame, key: str = "grp") -> DataFrame:
    """The text of each pack in its order."""
    rows = pack.where("id is not null").join(units.select(key, "id", "text"), [key, "id"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "text"))), lambda u: F.concat(F.lit("### "), u["id"], F.lit("\n"), u["text"]))
    return rows.groupBy(key).agg(F.array_join(texts, "\n\n").alias("rendered"))


def recall(pack: DataFrame, required: DataFrame, key: str = "grp") -> DataFrame:
    """The share of required ids in each pack, 1 if none is required."""
    have = pack.where("id is not null").select(key, "id").distinct().withColumn("got", F.lit(1.0))
    need = required.select(key, "id").join(have, [key, "id"], "left").groupBy(key).agg(F.avg(F.coalesce("got", F.lit(0.0))).alias("recall"))
    return pack.select(key).distinct().join(need, key, "left").select(key, F.coalesce("recall", F.lit(1.0)).alias("recall"))


def graded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with their highest evidence level, its name and the verdict for it."""
    top = evidence.groupBy("claim").agg(F.max("level").alias("level"))
    out = claims.join(top, "claim", "left").withColumn("level", F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)))
    return out.withColumns({"level_name": R.level_name(F.col("level").cast("int")), "verdict": R.verdict(F.col("level"))})


def publishable(claims: DataFrame, min_level: int, min_confidence: float) -> DataFrame:
    return claims.where((F.col("verdict") != "REJECTED") & F.col("calibrated") & (F.col("level") >= min_level) & (F.col("confidence") >= min_confidence))


def ungrounded(evidence: DataFrame, existing: DataFrame) -> DataFrame:
    """Cited places (file, line) that don't exist, per claim; an empty file cites nothing."""
    cited = evidence.where("file <> ''").select("claim", "file", "line")
    return cited.join(existing.select("file", "line").distinct(), ["file", "line"], "left_anti").groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "file", F.col("line").cast("string")))), ",").alias("missing"))

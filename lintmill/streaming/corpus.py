"""Rule statistics kept up to date as repositories' tables arrive: our own extension, since the reference merges in batches again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.operators.findings import merged_frequency

SCHEMA = "repo string, tool string, rule string, reported bigint, suppressed bigint, repos bigint"


def keep_merged(spark: SparkSession, incoming: str, store: str, merged: str, checkpoint: str) -> None:
    """Take what is new in ``incoming`` (Parquet of SCHEMA). A repository's new table replaces its old one in ``store``, and ``merged`` is made anew.

    A batch that runs again after a failure overwrites the same partitions, so the result is the same.
    """

    def merge(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(store)
        merged_frequency(batch.sparkSession.read.schema(SCHEMA).parquet(store)).write.mode("overwrite").parquet(merged)

    stream = spark.readStream.schema(SCHEMA).parquet(incoming)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window; rows later than ``late`` are dropped. Works on a table or a stream with a column ts."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

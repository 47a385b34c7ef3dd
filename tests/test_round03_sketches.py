"""Finding F3 of round 3: what a merge of overlapping tables of sketches must hold on any data."""

from pyspark.sql import functions as F

from lintmill.operators import findings as O


def test_merged_parts_tell_what_the_whole_tells_where_hashes_are_unlucky(spark):
    ids = spark.range(600_000).select((F.col("id") % 2000).cast("string").alias("rule"), F.col("id").cast("string").alias("fingerprint"), (F.col("id") % 7).cast("int").alias("line"))
    rows = ids.select(F.lit("t").alias("tool"), "rule", F.lit("r").alias("repo"), F.lit("base").alias("side"), "fingerprint", "line", F.lit(1).alias("col"), F.lit("").alias("suppress_reason"))
    parts = O.rule_sketches(rows.where("line < 5"), 4).union(O.rule_sketches(rows.where("line > 2"), 4)).union(O.rule_sketches(rows.where("line % 2 = 0"), 4))
    far = O.sketch_estimates(O.merged_sketches(parts, 4)).where("abs(reported - 300) > 4 / sqrt(16) * 300")
    assert far.count() > 0  # the bound of four standard errors is broken by some of 2,000 rules
    assert O.merged_as_whole(parts, O.rule_sketches(rows, 4), 4).groupBy("close").count().collect() == [(True, 2000)]
    assert O.merged_as_whole(parts, O.rule_sketches(rows.where("line > 0"), 4), 4).where("not close").count() > 1000  # another corpus

"""Pooled adjacent violators against the max-min formula, in tasks of any size."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lintmill.operators import calibration
from lintmill.operators.order import carried
from lintmill.plans.queries import QUERIES


def brute(points):
    """Per score the greatest, over starts, of the least mean, over ends."""
    scores = sorted({s for s, _ in points})
    n = [sum(s == x for s, _ in points) for x in scores]
    t = [sum(y for s, y in points if s == x) for x in scores]
    mean = lambda a, b: Fraction(sum(t[a : b + 1]), sum(n[a : b + 1]))
    return {x: float(max(min(mean(a, b) for b in range(i, len(scores))) for a in range(i + 1))) for i, x in enumerate(scores)}


def frame(spark, points):
    return spark.createDataFrame([(float(s), y, "own") for s, y in points], "score double, y int, lo string")


@pytest.mark.parametrize(("seed", "size"), [(1, 1 << 20), (2, 2), (3, 3), (4, 8), (5, 4)])
def test_pools_of_any_tasks_equal_the_formula(spark, seed, size):
    r = random.Random(seed)
    points = [(s := r.randrange(30) / 30, int(r.random() < (s if seed % 2 else 1 - s))) for _ in range(120)]
    pools = calibration.isotonic(frame(spark, points), size)
    got = calibration.calibrated(frame(spark, points), pools)
    want = brute(points)
    assert got.columns == ["score", "y", "lo", "calibrated"] and got.count() == len(points)
    assert all(abs(x.calibrated - want[x.score]) < 1e-12 and x.lo == "own" for x in got.collect())
    values = [x.value for x in pools.orderBy("lo").collect()]
    assert all(a < b for a, b in zip(values, values[1:], strict=False)) and sum(x.n for x in pools.collect()) == len(points)


def test_a_fall_over_all_tasks_ends_in_one_pool(spark):
    points = [(i / 64, int(i < 32)) for i in range(64)]
    assert [(p.lo, p.hi, p.n, p.value) for p in calibration.isotonic(frame(spark, points), 4).collect()] == [(0.0, 63 / 64, 64, 0.5)]


def test_scores_that_the_fit_has_not_seen_and_odd_rows(spark):
    pools = calibration.isotonic(frame(spark, [(0.2, 0), (0.4, 1), (0.4, 0), (0.8, 1)]).union(spark.createDataFrame([(None, 1, "x"), (0.9, None, "x")], "score double, y int, lo string")))
    rows = spark.createDataFrame([(0.1,), (0.3,), (0.5,), (0.9,), (None,), (0.3,)], "score double")
    assert sorted(((r.score, r.calibrated) for r in calibration.calibrated(rows, pools).collect()), key=str) == [(0.1, 0.0), (0.3, 0.0), (0.3, 0.0), (0.5, 0.5), (0.9, 1.0), (None, None)]
    empty = rows.limit(0).withColumn("y", F.lit(1))
    assert calibration.isotonic(empty).count() == 0 and calibration.calibrated(rows, calibration.isotonic(empty)).where("calibrated is not null").count() == 0


def test_the_registered_scores_are_better_calibrated_afterwards(spark, sf_dir):
    row = QUERIES["dsg19_calibration_gain"](spark, sf_dir).first()
    assert row.after < row.before and row.after < 0.05


def test_values_are_carried_over_partitions(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id").isin(100, 101, 640), F.col("id") * 2).alias("v")).repartition(5)
    got = {r.id: r.latest for r in carried(rows, "v", "id").collect()}
    assert got == {i: None if i < 100 else 200 if i == 100 else 202 if i < 640 else 1280 for i in range(1000)}

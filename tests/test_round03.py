"""Findings of round 3: what plans over the findings may shuffle and read."""

import pytest

from lintmill.plans.queries import QUERIES


@pytest.fixture
def unbroadcast(spark):
    """No table is small enough to be sent to every task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_findings_are_dealt_twice_at_most(spark, sf_dir, unbroadcast):
    plan = plan_of(spark, sf_dir, "flt02_classified")
    assert plan.count("Exchange hashpartitioning") <= 5  # findings by file and line, then by file; two of lines, one of files
    assert "hashpartitioning(repo" not in plan  # repeats are dropped where the lines are joined


def test_overlapping_tables_classify_once(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "agg06_overlapping")
    assert "l_partkey" not in plan and "WindowGroupLimit" not in plan  # the parts read what was classified and written


def test_types_travel_as_blocks_of_bits(spark):
    from lintmill.operators import callgraph as K

    every = sorted(f"T{i}" for i in range(150))
    allocations = spark.createDataFrame([("v0", t) for t in every] + [("v3", None), ("v5", "T7")], "variable string, type string")
    assignments = spark.createDataFrame([("v0", "v1"), ("v1", "v2"), ("v2", "v1"), ("v2", "v3"), ("v3", "v2")], "src string, dst string")
    sets, names = K.type_sets(allocations, assignments)  # a type without a name goes round the cycle and ends
    assert sets.count() == 4 * 3 + 1  # 151 types are 3 blocks
    got = {r.variable: (r.types, r.names) for r in K.type_lists(sets, names).collect()}
    assert got == {"v0": (150, ",".join(every)), **{v: (151, ",".join(every)) for v in ("v1", "v2", "v3")}, "v5": (1, "T7")}
    assert K.variable_types(allocations, assignments).count() == 150 + 3 * 151 + 1

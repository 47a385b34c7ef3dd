"""Plans and carried state of operators whose groups may have any size."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintmill.operators import evidence as E
from lintmill.operators.order import least_by_digest
from lintmill.plans.queries import QUERIES


def test_a_gate_limits_every_report_before_the_shuffle(spark, sf_dir):
    plan = QUERIES["flt10_posting_gate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # two for the dedupe, two for the gate


def test_no_source_is_sorted_whole_for_the_label_mix(spark, sf_dir):
    plan = QUERIES["dsg16_label_mix"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1 and "StartsWith" in plan  # of the rows at the border alone


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_least_by_digest_equals_a_sort(spark, most):
    r = random.Random(3)
    rows = [(r.choice("aab"), r.randrange(200)) for _ in range(700)] + [("c", 1)] * 30 + [(None, 4)]
    df = spark.createDataFrame(rows, "g string, n int")
    limits = spark.createDataFrame([("a", 123), ("b", 0), ("c", 7), ("d", 5)], "g string, most bigint")
    digest = F.sha2(F.col("n").cast("string"), 256)
    got = sorted((x.g, x.n) for x in least_by_digest(df, ("g",), limits, digest, "n", sorted_rows=most).collect())
    ordered = {g: sorted((x[2], x.n) for x in df.where(F.col("g") == g).withColumn("h", digest).collect()) for g in "ac"}
    assert got == sorted([("a", n) for _, n in ordered["a"][:123]] + [("c", 1)] * 7)
    assert least_by_digest(df.limit(0), ("g",), limits, digest, "n").count() == 0


def folded(units, budget):
    out = {}
    for g in {u[0] for u in units}:
        used, ids, own = 0, [], sorted((u for u in units if u[0] == g), key=lambda u: (-u[3], u[2]))
        for u in own:
            t = u[4] or (max(1, len((u[5] or "").encode()) // 4) if u[5] else 0)
            if used + t <= budget:
                used += t
                ids.append(u[1])
        out[g] = (used, len(own) - len(ids), ids)
    return out


def test_packing_carries_its_state_over_batches(spark):
    r = random.Random(8)
    units = [(r.randrange(4), f"u{i}", i, r.choice([10, 50, 90]), r.choice([0, 3, 40, 200, 5000]), r.choice(["", "a", "text of some length"])) for i in range(500)] + [(9, "big", 1, 1, 9999, "x"), (None, "n", 1, 1, 5, "x")]
    df = spark.createDataFrame(units, "grp int, id string, seq int, priority int, tokens bigint, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = E.packed(df, 700).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for x in sorted(rows, key=lambda x: -1 if x.place is None else x.place):
        got.setdefault(x.grp, (x.tokens, x.dropped, []))[2].extend([x.id] if x.id is not None else [])
    want = folded([u for u in units if u[0] is not None], 700)
    assert {g: x for g, x in got.items() if g is not None} == want and want[9] == (0, 1, [])


def test_a_long_group_is_folded_batch_by_batch():
    """Ten million units of one group, of which the fold ever holds a batch."""

    def batches():
        for i in range(100):
            n = 100_000
            yield pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([f"{i}"] * n), pa.array([1 + i] * n)], names=["grp", "id", "t"])

    before = pa.total_allocated_bytes()
    taken = most = 0
    for out in E._taken(50)(batches()):
        taken += out.num_rows
        most = max(most, pa.total_allocated_bytes() - before)
    assert taken == 50 and most < 20 << 20

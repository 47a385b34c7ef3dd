"""Centrality and histories against plain Python."""

import datetime

from lintmill.operators import designs as D
from lintmill.operators import graph as G


def walked(edges, damping=0.85, rounds=400):
    ids = sorted({x for e in edges for x in e[1:]})
    out = {i: {d for k, s, d in edges if k == "CALLS" and s == i} for i in ids}
    share = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        lost = sum(share[i] for i in ids if not out[i])
        share = {i: (1 - damping) / len(ids) + damping * (sum(share[j] / len(out[j]) for j in ids if i in out[j]) + lost / len(ids)) for i in ids}
    return share


def test_centrality_equals_plain_python(spark):
    edges = [("CALLS", f"f{i}", f"f{(i * i + 3) % 23}") for i in range(40)] + [("CALLS", "f1", "f1"), ("CALLS", "f1", "f2"), ("CALLS", "f1", "f2"), ("READS", "f50", "x1"), ("CALLS", "hub", "f3")] + [("CALLS", f"f{i}", "hub") for i in range(30)]
    got = {r.id: r.centrality for r in G.centrality(spark.createDataFrame(edges, "kind string, src string, dst string"), "CALLS", tolerance=1e-10).collect()}
    want = walked(edges)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want) and abs(sum(got.values()) - 1) < 1e-9
    assert max(got, key=got.get) == max(want, key=want.get)


def test_centrality_without_edges_of_the_kind_is_even(spark):
    e = spark.createDataFrame([("READS", "a", "b"), ("READS", "b", "c")], "kind string, src string, dst string")
    assert {r.id: round(r.centrality, 12) for r in G.centrality(e, "CALLS").collect()} == dict.fromkeys("abc", round(1 / 3, 12))
    assert G.centrality(e.limit(0), "CALLS").count() == 0


def test_the_plan_of_centrality_does_not_grow_with_rounds(spark):
    edges = spark.createDataFrame([("CALLS", f"f{i}", f"f{(i * 7 + 1) % 50}") for i in range(200)], "kind string, src string, dst string")
    scans = [G.centrality(edges, "CALLS", tolerance=0.0, max_rounds=n)._jdf.queryExecution().optimizedPlan().toString().count("Relation") for n in (2, 6)]
    assert scans[0] == scans[1] == 1


def test_histories_of_parts_of_the_changes_add_up(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(f"n{i % 7}" if i % 11 else None, i % 5 if i % 13 else None, day + datetime.timedelta(days=i * 17 % 900)) for i in range(300)]
    changes = spark.createDataFrame(rows, "id string, owner int, at date")
    whole = D.history(changes, "2022-01-31", 90.0)
    cut = datetime.date(2021, 2, 3)
    parts = D.history(changes.where(changes.at <= cut), str(cut), 90.0).unionByName(D.history(changes.where(changes.at > cut), "2022-01-31", 90.0))
    merged = D.merged_history(parts, "2022-01-31", 90.0)
    rounded = lambda df: sorted(((r.id, r.owner, r.changes, round(r.churn, 9), r.first, r.last) for r in df.collect()), key=str)
    assert rounded(merged) == rounded(whole)
    again = D.merged_history(D.merged_history(parts, "2021-12-31", 90.0), "2022-01-31", 90.0)
    assert rounded(again.where("last <= '2021-12-31'")) == rounded(whole.where("last <= '2021-12-31'"))
    last = datetime.date(2022, 1, 31)
    for r in D.history_features(whole).collect():
        own = [x for x in rows if x[0] == r.id and x[2] <= last]
        assert (r.changes, r.age_days, r.idle_days, r.owners) == (len(own), (last - min(x[2] for x in own)).days, (last - max(x[2] for x in own)).days, len({x[1] for x in own} - {None}))
        assert abs(r.churn - sum(0.5 ** ((last - x[2]).days / 90) for x in own)) < 1e-9

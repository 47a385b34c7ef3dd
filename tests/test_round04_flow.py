"""types flow within tasks, not in rounds that all tasks write."""

import random

import pytest

from lintmill.operators import callgraph as K


def closed(allocations, assignments):
    types, flow = {}, [(a, b) for a, b in assignments if a is not None]
    for v, t in allocations:
        types.setdefault(v, set()).add(t)
    while True:
        before = sum(map(len, types.values()))
        for a, b in flow:
            if a in types:
                types.setdefault(b, set()).update(types[a])
        if sum(map(len, types.values())) == before:
            return types


def example():
    r = random.Random(4)
    v = lambda: f"v{r.randrange(60)}"
    allocations = [(v(), f"T{r.randrange(1300)}") for _ in range(2600)] + [("v3", None), ("alone", None), (None, "T1"), ("w0", "T2")]
    assignments = [(v(), v()) for _ in range(45)] + [("v7", None), (None, "v8"), ("v9", "v9")] + [(f"w{i}", f"w{i + 1}") for i in range(40)]
    return allocations, assignments


def frames(spark, allocations, assignments):
    return spark.createDataFrame(allocations, "variable string, type string"), spark.createDataFrame(assignments, "src string, dst string")


@pytest.mark.parametrize("held", [K.HELD, 0])
def test_tasks_and_rounds_equal_plain_python(spark, monkeypatch, held):
    monkeypatch.setattr(K, "HELD", held)
    monkeypatch.setattr(K, "_BYTES", 1 << 15)
    monkeypatch.setattr(K, "_ROWS", 7)
    allocations, assignments = example()
    types = closed(allocations, assignments)
    names = {v: sorted(x for x in t if x is not None) for v, t in types.items()}
    got = K.variable_lists(*frames(spark, allocations, assignments)).collect()
    assert len(got) == len(types) and {r.variable: (r.types, r.names) for r in got} == {v: (len(t), ",".join(names[v]) if names[v] else None) for v, t in types.items()}
    asked = sorted({(f"v{i}", f"I{i % 7}", f"T{t}") for i in range(0, 60, 3) for t in range(0, 1300, 11)} | {("gone", "I0", "T0"), ("v1", "I1", "nowhere")})
    found = K.reached(spark.createDataFrame(asked, "receiver string, interface string, type string"), *frames(spark, allocations, assignments))
    want = [a for a in asked if a[2] in types.get(a[0], ())]
    assert sorted(map(tuple, found.collect())) == want and 0 < len(want) < len(asked)


def test_long_flows_are_not_written_round_by_round(spark, monkeypatch):
    wrote, write = [], K.written
    monkeypatch.setattr(K, "written", lambda df, name, *codec: wrote.append(name) or write(df, name, *codec))
    got = {r.variable: r.names for r in K.variable_lists(*frames(spark, [("w0", "A"), ("w20", "B")], [(f"w{i}", f"w{i + 1}") for i in range(40)])).collect()}
    assert got == {f"w{i}": "A" if i < 20 else "A,B" for i in range(41)}
    assert len(wrote) < 10  # one write per step of the flow before

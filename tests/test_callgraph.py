"""Call graphs built from types against plain Python."""

import random

import pytest

from lintmill.operators import callgraph as K


def brute(calls, methods, interfaces, allocations, assignments, parameters):
    needs, has = {}, {}
    for i, m in interfaces:
        needs.setdefault(i, set()).add(m)
    for t, m in methods:
        has.setdefault(t, set()).add(m)
    implements = {(i, t) for i, n in needs.items() for t, h in has.items() if n <= h}
    coarse = [(c[0], f"{t}.{c[3]}", c[4]) for c in calls for i, t in sorted(implements) if i == c[2]]
    flow = set(assignments) | {(a, v) for _, f, a in coarse if a for g, v in parameters if f == g}
    types = {}
    for v, t in allocations:
        types.setdefault(v, set()).add(t)
    while True:
        before = sum(map(len, types.values()))
        for a, b in flow:
            types.setdefault(b, set()).update(types.get(a, ()))
        if sum(map(len, types.values())) == before:
            break
    refined = [(c[0], f"{t}.{c[3]}") for c in calls for t in sorted(types.get(c[1], ())) if (c[2], t) in implements]
    return sorted(refined), sorted(c[:2] for c in coarse)


@pytest.mark.parametrize("seed", [1, 2])
def test_built_graphs_equal_plain_python(spark, seed):
    r = random.Random(seed)
    v = lambda: f"v{r.randrange(25)}"
    methods = [(f"T{r.randrange(8)}", f"m{r.randrange(5)}") for _ in range(30)]
    interfaces = [(f"I{r.randrange(5)}", f"m{r.randrange(5)}") for _ in range(9)]
    allocations = [(v(), f"T{r.randrange(8)}") for _ in range(10)] * 2
    assignments = [(v(), v()) for _ in range(25)] + [("v1", "v2"), ("v2", "v3"), ("v3", "v1"), ("v4", "v4")]
    calls = [(f"f{r.randrange(6)}", v(), *interfaces[r.randrange(9)], v() if r.random() < 0.5 else None) for _ in range(20)]
    parameters = [(f"{t}.{m}", v()) for t, m in sorted(set(methods))]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    refined, coarse = K.built(
        frame(calls, "src receiver interface method argument"), frame(methods, "type method"), frame(interfaces, "interface method"), frame(allocations, "variable type"), frame(assignments, "src dst"), frame(parameters, "function variable")
    )
    rows = lambda df: sorted(tuple(x) for x in df.select("src", "dst").collect())
    want = brute(calls, methods, interfaces, allocations, assignments, parameters)
    assert (rows(refined), rows(coarse)) == want and want[0] and len(want[0]) < len(want[1])


def test_a_long_chain_and_a_cycle_end(spark):
    chain = [(f"v{i}", f"v{i + 1}") for i in range(12)] + [("v12", "v5")]
    types = K.variable_types(spark.createDataFrame([("v0", "A"), ("v9", "B")], "variable string, type string"), spark.createDataFrame(chain, "src string, dst string"))
    got = {}
    for r in types.collect():
        got.setdefault(r.variable, set()).add(r.type)
    assert got == {f"v{i}": {"A", "B"} if i >= 5 else {"A"} for i in range(13)} and types.count() == 13 + 8

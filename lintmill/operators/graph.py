"""Operators on a code property graph: reachability, locks, accessors, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.functions import rules as R
from lintmill.operators.order import numbered
from lintmill.sources.store import forget, written


def of_kind(edges: DataFrame, *kinds: str) -> DataFrame:
    """Edges of the given kinds; none given means all."""
    return edges.where(F.col("kind").isin(*kinds)) if kinds else edges


def reachable(edges: DataFrame, roots: DataFrame, kind: str, max_hops: int, min_confidence: float, reverse: bool = False) -> DataFrame:
    """(root, id, hops): the least number of hops to every node within ``max_hops``, each edge at least so confident; roots reach others only.

    Level-synchronous: each hop joins the frontier with the distinct edges and leaves out what was reached before. Steps and frontiers are written to
    the shared folder, so a hop reads what earlier ones found instead of computing it again, and the walk ends with the first empty frontier.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = written(of_kind(edges, kind).where(F.col("confidence") >= min_confidence).select(F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "steps")
    frontier = written(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("hops")).distinct(), "frontier")
    visited = frontier
    for hop in range(1, max_hops + 1):
        found = frontier.join(steps, "id").select("root", F.col("next").alias("id")).distinct()
        frontier = written(found.join(visited, ["root", "id"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    return visited.where("hops > 0")


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges with their place by source, target and kind; producer, confidence and locks settle ties."""
    return numbered(edges, "src", "dst", "kind", "producer", "confidence", "locks")


def ordered_nodes(edges: DataFrame) -> DataFrame:
    """Node ids with their place in order."""
    return numbered(nodes(edges), "id")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def common_locks(accesses: DataFrame) -> DataFrame:
    """Per field: number of accesses, whether one writes, and the sorted locks that every access holds."""
    per = accesses.groupBy("dst").agg(F.count("*").alias("accesses"), F.bool_or(F.col("kind") == "WRITES").alias("has_write"))
    held = accesses.select("dst", F.explode(F.array_distinct("locks")).alias("lock")).groupBy("dst", "lock").agg(F.count("*").alias("n"))
    common = held.join(per, "dst").where(F.col("n") == F.col("accesses")).groupBy("dst").agg(F.array_sort(F.collect_set("lock")).alias("locks"))
    return per.join(common, "dst", "left").select(F.col("dst").alias("field"), "accesses", "has_write", F.array_join(F.coalesce("locks", F.expr("cast(array() as array<string>)")), ",").alias("locks"))


def lockset_fold(accesses: DataFrame) -> DataFrame:
    """The same intersection alone, over all accesses of each field (SET03)."""
    return common_locks(accesses).select("field", "locks")


def upserted(rows: DataFrame, key: str, order: str, last: bool = True) -> DataFrame:
    """One row per key: the last in order, or the first."""
    by = F.desc(order) if last else F.asc(order)
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(by))).where("__n = 1").drop("__n")


def call_graph(refined: DataFrame, coarse: DataFrame, vta_used: bool) -> DataFrame:
    """Call edges with producer and confidence: refined edges that the coarse set has are surer; without refinement the coarse ones count."""
    known = coarse.select("src", "dst").distinct().withColumn("known", F.lit(True))
    source = refined if vta_used else coarse
    out = source.join(known, ["src", "dst"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return out.withColumns({"producer": F.lit("vta" if vta_used else "cha"), "confidence": R.edge_confidence(F.lit(vta_used), F.col("known"))}).drop("known")


def call_graph_result(before: DataFrame, calls: DataFrame, vta_used: bool) -> DataFrame:
    """One row: nodes that the call edges add to a graph, the edges added, and whether they were refined (AGG16)."""
    added = nodes(calls).join(nodes(before), "id", "left_anti").agg(F.count("*").alias("nodes_added"))
    return added.crossJoin(calls.agg(F.count("*").alias("edges_added"))).withColumn("vta_used", F.lit(vta_used))  # one row each


def race_candidates(edges: DataFrame, roots: DataFrame, max_hops: int = 3, min_confidence: float = 0.6) -> DataFrame:
    """Fields that at least two roots reach, one access writes and no lock is common to all accesses (a design of the reference)."""
    reach = reachable(edges, roots, "CALLS", max_hops, min_confidence).select("root", F.col("id").alias("src"))
    reach = reach.union(roots.select(F.col("id").alias("root"), F.col("id").alias("src")))
    accesses = of_kind(edges, "READS", "WRITES")
    by_root = accesses.join(reach, "src").groupBy(F.col("dst").alias("field")).agg(F.count_distinct("root").alias("roots"))
    return by_root.where("roots >= 2").join(common_locks(accesses).where("has_write and locks = ''"), "field").select("field", "roots", "accesses")


def centrality(edges: DataFrame, kind: str, damping: float = 0.85, tolerance: float = 1e-12, max_rounds: int = 1000) -> DataFrame:
    """(id, centrality) of every node of the graph: the share of time that a walk spends there which follows a random edge of ``kind``, or, from nodes without
    one and else in 1 - ``damping`` of all steps, goes anywhere (DSG09).

    Parallel edges count once. Each round joins the shares with the edges, adds up what arrives per node before the shuffle, and is written, so the
    plan stays that of one round. The mass of nodes without edges follows from what did not arrive. Rounds end when all changes together are below ``tolerance``.
    """
    steps = of_kind(edges, kind).select("src", "dst").distinct()
    degrees = steps.groupBy("src").agg(F.count("*").alias("degree"))
    steps = written(steps.join(degrees, "src").select("src", "dst", (1.0 / F.col("degree")).alias("part")), "steps")
    every = written(nodes(edges), "nodes")
    n = every.count()
    shares = every.withColumn("centrality", F.lit(1.0 / max(n, 1)))
    last = None
    for _ in range(max_rounds if n else 0):
        arrived = steps.join(shares, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("centrality") * F.col("part")).alias("arrived"))
        found = written(shares.withColumnRenamed("centrality", "before").join(arrived, "id", "left").withColumn("arrived", F.coalesce("arrived", F.lit(0.0))), "shares")
        lost = found.agg(F.sum("before") - F.sum("arrived")).first()[0]
        shares = found.select("id", "before", ((1 - damping) / n + damping * (F.col("arrived") + lost / n)).alias("centrality"))
        change = shares.agg(F.sum(F.abs(F.col("centrality") - F.col("before")))).first()[0]
        shares = shares.drop("before")
        if last is not None:
            forget(last)
        last = found
        if change < tolerance:
            break
    return shares


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of undirected edges (a, b): the least id that each one reaches.

    Every step points an id's neighbours at the least id known there, larger and smaller neighbours in turn, and is written; it ends when a step changes no edge.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    old = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        forget(edges)
        edges, now = new, state(new)
        if now == old:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        old = now

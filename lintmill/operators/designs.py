"""Operators that are described as designs only; where a formula is missing there, it is ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.operators import graph as G
from lintmill.operators.order import least_by_digest


def neighbourhood(edges: DataFrame, roots: DataFrame, kind: str, max_hops: int, min_confidence: float) -> DataFrame:
    """(root, id, hops) of callers and callees together (DSG01): the least number of hops in either direction."""
    both = [G.reachable(edges, roots, kind, max_hops, min_confidence, reverse=reverse) for reverse in (False, True)]
    return both[0].union(both[1]).groupBy("root", "id").agg(F.min("hops").alias("hops"))


def impact(edges: DataFrame, changed: DataFrame, hops: dict[str, int], min_confidence: float) -> DataFrame:
    """(id, kind, hops) of what reaches a changed node backwards by edges of each kind (DSG05), within that kind's number of hops."""
    out = None
    for kind, most in hops.items():
        one = G.reachable(edges, changed, kind, most, min_confidence, reverse=True).groupBy("id").agg(F.min("hops").alias("hops")).select("id", F.lit(kind).alias("kind"), "hops")
        out = one if out is None else out.union(one)
    return out


def access_gaps(required: DataFrame, granted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every required or granted access once (DSG06), as missing, unused or ok."""
    a, b = (x.select(*keys).distinct().withColumn(n, F.lit(True)) for x, n in ((required, "__need"), (granted, "__have")))
    state = F.when(F.col("__have").isNull(), "missing").when(F.col("__need").isNull(), "unused").otherwise("ok")
    return a.join(b, list(keys), "full").select(*keys, state.alias("state"))


def chained(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """(source, target, paths): how many paths lead along one edge (src, dst) of each table in turn (DSG08); counts are added before each join."""
    out = first.groupBy(F.col("src").alias("source"), F.col("dst").alias("target")).agg(F.count("*").alias("paths"))
    for step in rest:
        counted = step.groupBy("src", "dst").agg(F.count("*").alias("n"))
        joined = out.join(counted, out["target"] == counted["src"]).select("source", F.col("dst").alias("target"), (F.col("paths") * F.col("n")).alias("paths"))
        out = joined.groupBy("source", "target").agg(F.sum("paths").alias("paths"))
    return out


def ranking_features(edges: DataFrame, roots: DataFrame, kind: str, max_hops: int, min_confidence: float) -> DataFrame:
    """Per node (DSG09): different callers and callees, accesses, and the least hops from a root (null: none reaches it)."""
    calls = G.of_kind(edges, kind).select("src", "dst").distinct()
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    touched = edges.where(F.col("kind") != kind).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("accesses"))
    distance = G.reachable(edges, roots, kind, max_hops, min_confidence).groupBy("id").agg(F.min("hops").alias("entry_distance"))
    rows = into.join(out, "id", "full").join(touched, "id", "full").join(distance, "id", "left")
    return rows.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "accesses")], "entry_distance")


def guards(accesses: DataFrame) -> DataFrame:
    """(lock, field): a lock that all accesses of a field hold guards it (DSG10)."""
    found = G.common_locks(accesses).where("locks <> ''")
    return found.select(F.explode(F.split("locks", ",")).alias("lock"), "field")


def recipe_context(findings: DataFrame, recipes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per finding (keys kept) the nodes that its category's recipe asks for (DSG12): (category, kind) rows name the edges to follow from its function."""
    wanted = findings.join(F.broadcast(recipes), "category")  # a row per category and kind of edge
    steps = edges.select(F.col("src").alias("function"), "kind", "dst").distinct()
    return wanted.join(steps, ["function", "kind"])


def splits(rows: DataFrame, date: str, pair: str, held_out, train_until: str, validate_until: str) -> DataFrame:
    """``rows`` with their split (DSG15): by the latest date of a pair, so that pairs stay together; held-out repositories are test rows."""
    latest = rows.groupBy(pair).agg(F.max(date).alias("__latest"), F.bool_or(held_out).alias("__out"))
    split = F.when(F.col("__out"), "test").when(F.col("__latest") < F.lit(train_until), "train").when(F.col("__latest") < F.lit(validate_until), "validation").otherwise("test")
    return rows.join(latest.withColumn("split", split).drop("__latest", "__out"), pair)


def label_mix(examples: DataFrame, negative, part: int, whole: int, order) -> DataFrame:
    """``examples`` (source, ...) with hard negatives at ``part`` in ``whole`` of a source's rows at least (DSG16): all of them, and as many others, in
    ``order``, as that allows; its first column is a hexadecimal digest. Sources of any size: none is sorted whole."""
    limits = examples.groupBy("source").agg(F.floor(F.count_if(negative) * (whole - part) / part).alias("most"))
    return least_by_digest(examples.where(~negative), ("source",), limits, *order).unionByName(examples.where(negative))


def weighted_rate(votes: DataFrame, least: float) -> DataFrame:
    """Per group the rate of positive labels (DSG17), each source weighted by its agreement; sources that agree in less than ``least`` are dropped."""
    agreement = votes.groupBy("source").agg(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("weight")).where(F.col("weight") >= least)
    joined = votes.join(agreement, "source")
    return joined.groupBy("grp").agg(F.count("*").alias("n"), (F.sum(F.col("weight") * F.col("a")) / F.sum("weight")).alias("rate"))


def reindex(before: DataFrame, after: DataFrame, edges: DataFrame, max_hops: int, min_confidence: float) -> DataFrame:
    """(id, hops) to index again (DSG23): changed, new and removed files (id, hash) at 0, and what depends on them within ``max_hops``."""
    joined = before.withColumnRenamed("hash", "__old").join(after.withColumnRenamed("hash", "__new"), "id", "full")
    changed = joined.where(~F.col("__old").eqNullSafe(F.col("__new"))).select("id").distinct()
    reached = G.reachable(edges, changed, "CALLS", max_hops, min_confidence, reverse=True).select("id", "hops")
    return changed.withColumn("hops", F.lit(0)).union(reached).groupBy("id").agg(F.min("hops").alias("hops"))


def supported(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """``findings`` with a function, and whether they may stand (DSG24): high and critical ones need an edge there that no model made."""
    facts = edges.groupBy(F.col("src").alias("function")).agg(F.bool_or(F.col("producer") != "model").alias("__fact"))
    out = findings.join(facts, "function", "left")
    return out.withColumn("supported", ~F.col("priority").isin("high", "critical") | F.coalesce("__fact", F.lit(False))).drop("__fact")


def retrieval_pairs(fixed: DataFrame, touched: DataFrame) -> DataFrame:
    """Findings with each unit that their fix touched (DSG25)."""
    return fixed.join(touched, "doc_id").distinct()


def serving_cost(load: DataFrame, seconds_per_candidate: float, price_per_hour: float) -> DataFrame:
    """``load`` (requests, candidates) with the seconds and the price of its requests (DSG26)."""
    seconds = F.col("requests") * F.col("candidates") * F.lit(seconds_per_candidate)
    return load.withColumn("gpu_seconds", seconds).withColumn("price", F.col("gpu_seconds") / 3600.0 * price_per_hour)


_HISTORY = ("id", "owner")


def history(changes: DataFrame, now, half_life_days: float) -> DataFrame:
    """Per node and owner (id, owner) of changes (id, owner, at): as_of, changes, churn, first and last (DSG09). Churn counts a change less the older it is, a half after ``half_life_days``.

    Such tables of different parts of the changes, taken at different times, are put together by ``merged_history``. Changes after ``now`` are left out.
    """
    at, now = F.col("at").cast("date"), F.lit(now).cast("date")
    old = F.date_diff(now, at)
    counted = changes.where(F.col("id").isNotNull() & (at <= now)).groupBy(*_HISTORY)
    return counted.agg(F.lit(now).alias("as_of"), F.count("*").alias("changes"), F.sum(F.pow(F.lit(0.5), old / half_life_days)).alias("churn"), F.min(at).alias("first"), F.max(at).alias("last"))


def merged_history(tables: DataFrame, now, half_life_days: float) -> DataFrame:
    """``history`` tables, of one schema and any times up to ``now``, as one at ``now``: what was counted before decays by the time since then."""
    since = F.date_diff(F.lit(now).cast("date"), F.col("as_of"))
    return tables.groupBy(*_HISTORY).agg(
        F.lit(now).cast("date").alias("as_of"), F.sum("changes").alias("changes"), F.sum(F.col("churn") * F.pow(F.lit(0.5), since / half_life_days)).alias("churn"), F.min("first").alias("first"), F.max("last").alias("last")
    )


def history_features(table: DataFrame) -> DataFrame:
    """Per node: changes, churn, age and days since the last change, and how many owners it has, from one ``history`` table."""
    as_of = F.max("as_of")
    return table.groupBy("id").agg(
        F.sum("changes").alias("changes"), F.sum("churn").alias("churn"), F.date_diff(as_of, F.min("first")).alias("age_days"), F.date_diff(as_of, F.max("last")).alias("idle_days"), F.count("owner").alias("owners")
    )


def exposure(edges: DataFrame, entries: DataFrame, tests: DataFrame, kind: str, max_hops: int, min_confidence: float) -> DataFrame:
    """Per node with edges of ``kind`` (DSG09): how many entries and how many tests (id) reach it within ``max_hops``, whether it is exposed and whether it is covered."""
    every = G.nodes(G.of_kind(edges, kind))
    by = lambda roots, name: G.reachable(edges, roots, kind, max_hops, min_confidence).groupBy("id").agg(F.count("*").alias(name))
    rows = every.join(by(entries, "entries"), "id", "left").join(by(tests, "tests"), "id", "left")
    entries_, tests_ = (F.coalesce(c, F.lit(0)) for c in ("entries", "tests"))
    return rows.select("id", entries_.alias("entries"), tests_.alias("tests"), (entries_ > 0).alias("exposed"), (tests_ > 0).alias("covered"))

"""Exact and indexed search for nearest vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintmill.operators import vectors as V
from lintmill.plans.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id bigint, v array<float>")


def brute(rows, queries, k):
    unit = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v is not None and np.linalg.norm(v) > 0}
    out = {}
    for q in queries:
        if q in unit:
            near = sorted((-round(float(unit[q] @ unit[i]) / np.linalg.norm(unit[q]) / np.linalg.norm(unit[i]), 6), i) for i in unit if i != q)
            out[q] = [i for _, i in near[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("qid", "place").collect():
        out.setdefault(r.qid, []).append(r.vec_id)
    return out


@pytest.mark.parametrize(("queries", "vectors"), [(1024, 1 << 16), (3, 10)])
def test_exact_search_in_blocks_of_any_size(spark, monkeypatch, queries, vectors):
    monkeypatch.setattr(V, "QUERY_BLOCK", queries)
    monkeypatch.setattr(V, "VECTOR_BLOCK", vectors)
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).round(3)) for i in range(120)] + [(200, [0.0] * 8), (201, None), (202, [1.0] * 8), (203, [1.0] * 8), (None, [2.0] * 8)]
    df = frame(spark, rows).repartition(3)
    asked = [*range(0, 120, 5), 200, 201, 202]
    assert by_query(V.nearest(df, df.where(F.col("vec_id").isin(asked)), 4)) == brute([x for x in rows if x[0] is not None], asked, 4)
    assert V.nearest(df, df.limit(0), 4).count() == 0 and V.nearest(df.limit(0), df, 4).count() == 0


def test_an_index_of_clustered_vectors_asks_a_few_lists(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16)) * 4
    rows = [(i, centres[i % 30] + r.normal(size=16)) for i in range(3000)]
    df = frame(spark, rows)
    centroids, probes = V.fitted(df)
    index = V.indexed(df, centroids)
    queries = df.where("vec_id % 20 = 0")
    exact, found = by_query(V.nearest(df, queries, 5)), by_query(V.search(index, centroids, queries, 5, probes))
    assert index.count() == 3000 and len(centroids) == 54 and probes <= 8
    assert sum(len(set(exact[q]) & set(found.get(q, ()))) for q in exact) >= 0.9 * sum(map(len, exact.values()))
    assert by_query(V.search(index, centroids, queries, 5, len(centroids))) == exact == by_query(V.search_all(index, centroids, queries, 5, 1))


def test_exact_search_through_the_index_asks_few_lists_of_clustered_vectors(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16))
    rows = [(i, centres[i % 40] + r.normal(size=16) * 0.02) for i in range(2000)] + [(3000, [0.0] * 16), (3001, None)]
    df = frame(spark, rows)
    centroids, _ = V.fitted(df)
    met, index, queries = [], V.indexed(df, centroids), df.where("vec_id % 20 = 0 or vec_id > 2999")
    plain = V._met
    monkeypatch.setattr(V, "_met", lambda q, v, k, block=None: met.append(q.where("vec_id < 3000").count()) or plain(q, v, k, block))
    assert by_query(V.search_all(index, centroids, queries, 5, 2)) == by_query(plain(*(V._usable(x).select(F.lit(0).alias("list"), "vec_id", "v") for x in (queries, df)), 5))
    assert met[0] == 200 and met[1] < 100 * 10  # of 44 lists


def test_a_long_list_is_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 50)
    rows = [(i, [1.0, i / 1000]) for i in range(600)]
    df = frame(spark, rows)
    centroids, _ = V.fitted(df, lists=2)
    index = V.indexed(df, centroids)
    queries = df.where("vec_id % 20 = 0")
    assert by_query(V.search(index, centroids, queries, 3, 2)) == by_query(V.nearest(df, queries, 3)) == brute(rows, range(0, 600, 20), 3)


def test_recall_of_the_index_on_the_test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    centroids, probes = V.fitted(df)
    queries = df.where("vec_id % 20 = 0")
    exact, found = by_query(QUERIES["dsg13_rerank"](spark, sf_dir)), by_query(V.search(V.indexed(df, centroids), centroids, queries, 5, probes))
    assert sum(len(set(exact[q]) & set(found.get(q, ()))) for q in exact) >= 0.9 * sum(map(len, exact.values()))


def test_one_vector_and_none(spark):
    df = frame(spark, [(1, [1.0, 2.0])])
    centroids, probes = V.fitted(df)
    assert V.search(V.indexed(df, centroids), centroids, df, 5, probes).count() == 0

"""Search for the nearest vectors of a stated query set: exactly, or through an index of lists around centroids.

Both deal queries and vectors to cells. A cell holds at most ``QUERY_BLOCK`` queries of one list and meets some ``VECTOR_BLOCK`` of the list's vectors,
which stream past a matrix of the queries in batches, so a task's memory is bounded however long a list is; the exact search is one list. Nothing of
either side passes through the driver but how many rows a list has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.sources.store import written

QUERY_BLOCK, VECTOR_BLOCK = 1024, 1 << 16
#: The centroids are fitted on at most so many vectors, those whose ids have the least hashes; every vector is then indexed.
SAMPLE, LISTS, ROUNDS = 20_000, 1024, 12
#: Sampled vectors that are asked for their neighbours, to see how many lists it takes.
TUNED = 500
_FOUND = "qid bigint, vec_id bigint, cosine double"


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; those of length zero become NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _cells(k: int):
    """Over rows (list, qpart, vpart, kind, vec_id, v) sorted in that order: a cell's queries (kind 0), then its vectors; yields the ``k`` best of each query."""

    def run(batches):
        key, ids, wanted, best, names = None, [], [], None, None

        def flush():
            if best is not None:
                at, query = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(all_ids[query]), pa.array(names[at, query]), pa.array(best[at, query] + 0.0)], names=["qid", "vec_id", "cosine"])

        all_ids = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                part, cell, kind = batch.slice(lo, hi - lo), tuple(keys[lo, :3].tolist()), keys[lo, 3]
                own = _unit(_matrix(part.column(5), hi - lo))
                name = part.column(4).to_numpy()
                if cell != key:
                    yield from flush()
                    key, ids, wanted, best, names = cell, [], [], None, None
                if kind == 0:
                    usable = np.isfinite(own).all(axis=1)
                    ids.append(name[usable])
                    wanted.append(own[usable])
                    continue
                if best is None:
                    if not ids:
                        continue
                    all_ids, matrix = np.concatenate(ids), np.concatenate(wanted)
                    best, names = np.full((0, len(all_ids)), -np.inf), np.zeros((0, len(all_ids)), dtype=np.int64)
                cosine = np.round(own @ matrix.T, 6)
                cosine[(name[:, None] == all_ids[None, :]) | ~np.isfinite(cosine)] = -np.inf
                every, label = np.vstack([best, cosine]), np.vstack([names, np.broadcast_to(name[:, None], cosine.shape)])
                order = np.lexsort((label, -every), axis=0)[:k]
                best, names = np.take_along_axis(every, order, 0), np.take_along_axis(label, order, 0)
        yield from flush()

    return run


def _met(queries: DataFrame, vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(qid, vec_id, cosine, place) of the ``k`` best for each query among the vectors of its lists; both have (list, vec_id, v)."""
    def parts(rows: DataFrame, size: int):
        """How many parts each list's rows are dealt to, from a count per list, of which there are LISTS at most."""
        counts = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}
        return F.coalesce(F.get(F.array(*(F.lit(-(-counts.get(i, 0) // size)) for i in range(max(counts, default=0) + 1))), F.col("list")), F.lit(0))

    qparts, vparts = parts(queries, block or QUERY_BLOCK), parts(vectors, VECTOR_BLOCK)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    met = lambda rows: rows.where((qparts > 0) & (vparts > 0))
    asked = met(queries).select("list", own(qparts).alias("qpart"), each(vparts).alias("vpart"), F.lit(0).alias("kind"), "vec_id", "v")
    there = met(vectors).select("list", each(qparts).alias("qpart"), own(vparts).alias("vpart"), F.lit(1).alias("kind"), "vec_id", "v")
    cells = asked.unionByName(there).repartition("list", "qpart", "vpart").sortWithinPartitions("list", "qpart", "vpart", "kind")
    found = cells.mapInArrow(_cells(k), _FOUND)
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("place") <= k)
    return ranked.withColumn("place", F.col("place").cast("bigint"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(qid, vec_id, cosine, place) of the ``k`` vectors (vec_id, v) of the greatest cosine to each query of the same form, itself left out. Exact.

    Cosines have six decimals; of equal ones the smaller id comes first. Vectors of length zero have no cosine and are nobody's neighbour; a query with
    null for a vector, or of length zero, has none. All vectors have one dimension. Every vector meets every query, so the work grows with both.
    """
    one = lambda rows: _usable(rows).select(F.lit(0).alias("list"), "vec_id", "v")
    return _met(one(queries), one(vectors), k, block)


def fitted(vectors: DataFrame, lists: int | None = None, k: int = 5, recall: float = 0.95) -> tuple[np.ndarray, int]:
    """Centroids of length one, and how many lists around a query hold ``recall`` of its ``k`` nearest, by the sample.

    Spherical k-means over ``SAMPLE`` vectors at most; as many centroids as the square root of all vectors, ``LISTS`` at most, if not given. How many
    lists it takes is the data's: vectors in clusters need a few, vectors without any need most.
    """
    rows = _usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # bounded
    own = _unit(_matrix(sample["v"].combine_chunks(), sample.num_rows)) if sample.num_rows else np.zeros((0, 1))
    own = own[np.isfinite(own).all(axis=1)]
    count = max(1, min(lists or int(rows.count() ** 0.5), LISTS, len(own)))
    centroids = own[:count].copy()
    for _ in range(ROUNDS if len(own) else 0):
        at = np.argmax(own @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, own)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centroids)
    if len(own) <= 1:
        return centroids, 1
    asked = own[-TUNED:]
    near = asked @ own.T
    near[np.arange(len(asked)), np.arange(len(own) - len(asked), len(own))] = -np.inf
    home = np.argmax(own @ centroids.T, axis=1)[np.argsort(-near, axis=1)[:, : min(k, len(own) - 1)]]
    turn = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # at which turn a query comes to each list
    turns = np.sort(np.take_along_axis(turn, home, axis=1).ravel())
    return centroids, int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)]) + 1


def _listed(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``rows`` in the lists of their ``probes`` nearest centroids."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.nan_to_num(_unit(_matrix(batch.column(1), batch.num_rows)), nan=0.0) @ centroids.T
            lists = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            again = pa.array(np.repeat(np.arange(batch.num_rows), lists.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column(0).take(again), batch.column(1).take(again)], names=["list", "vec_id", "v"])

    return _usable(rows).mapInArrow(run, "list int, vec_id bigint, v array<double>")


def indexed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector (list, vec_id, v) in the list of its nearest centroid, written to the shared folder by list."""
    return written(_listed(vectors, centroids, 1).repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(16))).sortWithinPartitions("list"), "vector-lists")


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """As ``nearest``, among the vectors of the ``probes`` lists around each query; with all lists it is the same. Queries and vectors are joined by list."""
    return _met(_listed(queries, centroids, min(probes, len(centroids))), index, k)


def _reach(index: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Per list the angle of its farthest vector from the centroid; NaN for a list without vectors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = batch.column(0).to_numpy()
                cosine = np.nan_to_num((_unit(_matrix(batch.column(2), batch.num_rows)) * centroids[at]).sum(axis=1), nan=1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cosine)], names=["list", "cosine"])

    out = np.full(len(centroids), np.nan)
    for r in index.mapInArrow(run, "list int, cosine double").groupBy("list").agg(F.min("cosine").alias("least")).collect():  # a row per list
        out[r["list"]] = np.arccos(np.clip(r["least"], -1.0, 1.0))
    return out


def search_all(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Exactly as ``nearest``, through the index: after the first ``probes`` lists, a query asks just those others that can hold a better vector.

    By the triangle inequality no vector of a list is nearer to a query than the centroid's angle less the list's reach. Vectors in clusters leave few such lists.
    """
    near = written(search(index, centroids, queries, k, probes), "near")
    reach, first = _reach(index, centroids), min(probes, len(centroids))
    last = near.where(F.col("place") == k).select(F.col("qid").alias("__qid"), F.col("cosine").alias("kth"))
    asked = _usable(queries)
    asked = asked.join(last, asked["vec_id"] == F.col("__qid"), "left").select("vec_id", "v", "kth")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.nan_to_num(_unit(_matrix(batch.column(1), batch.num_rows)), nan=0.0) @ centroids.T
            best = np.cos(np.maximum(np.arccos(np.clip(cosine, -1.0, 1.0)) - reach, 0.0))
            kth = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float), nan=-2.0)
            ask = best >= kth[:, None] - 2e-6  # cosines are rounded to six decimals
            np.put_along_axis(ask, np.argsort(-cosine, axis=1, kind="stable")[:, :first], False, axis=1)
            row, lists = np.nonzero(ask)
            again = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column(0).take(again), batch.column(1).take(again)], names=["list", "vec_id", "v"])

    rest = written(asked.mapInArrow(run, "list int, vec_id bigint, v array<double>"), "asked")
    both = near.drop("place").unionByName(_met(rest, index, k).drop("place"))
    ranked = both.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("place") <= k)
    return ranked.withColumn("place", F.col("place").cast("bigint"))

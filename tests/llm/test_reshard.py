"""Resharding: the flow against exhaustive search, the layout's law, and the rewritten files against plain Python."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintmill.llm import reshard
from lintmill.llm.queries import QUERIES


def cheapest(supply, room, cost):
    """The least cost of any integer flow, by trying all."""
    if not supply:
        return 0
    best, n = None, len(room)
    for split in itertools.product(range(supply[0] + 1), repeat=n):
        if sum(split) == supply[0] and all(a <= b for a, b in zip(split, room, strict=True)):
            rest = cheapest(supply[1:], [b - a for a, b in zip(split, room, strict=True)], cost[1:])
            if rest is not None and (best is None or rest + sum(a * c for a, c in zip(split, cost[0], strict=True)) < best):
                best = rest + sum(a * c for a, c in zip(split, cost[0], strict=True))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_the_flow_is_the_cheapest_of_all(seed):
    r = random.Random(seed)
    m, n = r.choice([(2, 3), (3, 2), (3, 3)])
    supply, cost = [r.randrange(5) for _ in range(m)], [[r.randrange(6) for _ in range(n)] for _ in range(m)]
    room = [r.randrange(6) for _ in range(n)]
    room[0] += max(0, sum(supply) - sum(room))
    flow = reshard.min_cost_flow(np.array(supply), np.array(room), np.array(cost))
    assert flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= room).all() and (flow >= 0).all()
    assert (flow * cost).sum() == cheapest(supply, room, cost)


def test_a_flow_without_room_is_an_error():
    with pytest.raises(ValueError, match="less room"):
        reshard.min_cost_flow(np.array([3]), np.array([2]), np.array([[0]]))


@pytest.mark.parametrize("olds", [[5000, 10, 10, 900], [100] * 24, [0] * 3 + [7000], [300] * 40])
def test_small_blocks_are_dealt_evenly_and_few_bytes_move(olds):
    r = random.Random(7)
    blocks = [(o, k, 0, 0, size, 1) for o, n in enumerate(olds) for k, size in enumerate(r.randrange(1, 200) for _ in range(n))]
    got = reshard.laid_out(blocks, 24)
    loads = collections.Counter()
    for b, j in zip(got.blocks, got.shard, strict=True):
        loads[j] += b[4]
    fair = sum(b[4] for b in blocks) / 24
    assert [loads[j] for j in range(24)] == got.sizes and max(got.sizes) - min(got.sizes) <= max(fair / 1000, 200)
    assert got.least_moved <= got.moved <= got.least_moved + 24 * 200 * 3
    assert got.moved == sum(b[4] for b, j in zip(got.blocks, got.shard, strict=True) if b[0] != j) == sum(got.transfers.values())


def test_blocks_as_large_as_a_shard():
    sizes = [1000, 900, 5, 5, 5, 400, 400, 1]
    got = reshard.laid_out([(0, k, 0, 0, s, 1) for k, s in enumerate(sizes)], 4)
    assert max(got.sizes) == 1000 and got.shard[0] == 0 and min(got.sizes) >= 400


def checked(rows, docs, shards=24):
    """rows: (doc_id, size, crc, shard, slot). Every row once, slots without gaps; returns the shards' bytes."""
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert collections.Counter(r[:3] for r in rows) == want
    slots, sizes = collections.defaultdict(list), [0] * shards
    for _, size, _, shard, slot in rows:
        slots[shard].append(slot)
        sizes[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_the_query_keeps_its_law(spark, sf_dir, documents):
    got = QUERIES["op13_reshard"](spark, sf_dir).collect()
    sizes = checked([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], [(r.doc_id, r.text) for r in documents])
    largest = sorted((r.size for r in got), reverse=True)
    above = [s for s in sizes if s > sum(sizes) / 24 * 1.05]
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert len(above) <= sum(s > sum(sizes) / 24 for s in largest) and max(sizes) <= max(largest[0], sum(sizes) / 24 * 1.1)  # a shard of one long text can't be evened out


def test_a_layout_does_not_depend_on_the_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = F.pmod(F.crc32("source"), F.lit(16))
    a, b = (sorted((r.doc_id, r.shard, r.slot) for r in reshard.report(d, old).collect()) for d in (docs, docs.repartition(7).orderBy(F.desc("doc_id"))))
    assert a == b


def test_odd_rows_and_clashing_names(spark, odd, empty):
    docs = odd.withColumns({"shard": F.lit("own"), "slot": F.lit(-1), "old": F.col("key"), "row": F.lit("r"), "hash": F.lit(2.5)})
    rows, layout = reshard.resharded(docs, F.when(F.col("doc_id") % 2 == 0, 5), 3)
    assert rows.columns == [*docs.columns, "_shard", "_slot"] and layout.least_moved > 0
    out = rows.collect()
    checked([(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), r["_shard"], r["_slot"]) for r in out], [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert {(r["shard"], r["slot"], r["row"], r["hash"]) for r in out} == {("own", -1, "r", 2.5)}
    assert reshard.report(empty, F.lit(0)).count() == 0 and reshard.report(empty, F.lit(0)).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_a_repeated_row_is_dealt_by_its_place(spark, tmp_path):
    """A third of all rows are one row; told apart by their places they spread, without that they stay together."""
    path = f"file://{tmp_path}/docs"
    rows = [(7, "the same text again and again " * 5)] * 3000 + [(i, f"text {i} " * (i % 40)) for i in range(100, 6100)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    got = reshard.report(docs, F.lit(0), place, 8).collect()
    sizes = checked([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], rows, 8)
    assert max(sizes) - min(sizes) <= sum(sizes) / 8 / 100 and len({r.shard for r in got if r.doc_id == 7}) > 1
    together = reshard.report(docs, F.lit(0), None, 8).collect()
    assert len({r.shard for r in together if r.doc_id == 7}) == 1


def test_shards_that_nothing_enters_or_leaves_are_not_written(spark, tmp_path):
    rows = [(i, f"text {i:04d}", i % 4 if i < 4000 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, at int")
    same, layout = reshard.resharded(docs, F.col("at"), 4, path=f"file://{tmp_path}/same")
    assert not layout.transfers and not (tmp_path / "same").exists()
    checked([(r.doc_id, 17, zlib.crc32(r.text.encode()), r.shard, r.slot) for r in same.collect()], [r[:2] for r in rows], 4)
    assert all(r["shard"] == r["at"] for r in same.collect())
    more = docs.withColumn("text", F.when(F.col("at") == 0, F.repeat("text", 3)).when(F.col("at") == 1, F.lit("t")).otherwise(F.rpad("text", 13, "x")))
    part, layout = reshard.resharded(more, F.col("at"), 4, path=f"file://{tmp_path}/part")
    written = {int(p.name.partition("=")[2]) for p in (tmp_path / "part").glob("shard=*")}
    assert written == layout.affected() and {0, 1} <= written
    checked([(r.doc_id, len(r.text) + 8, zlib.crc32(r.text.encode()), r.shard, r.slot) for r in part.collect()], [(r.doc_id, r.text) for r in more.collect()], 4)

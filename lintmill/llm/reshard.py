"""Resharding by a minimum-cost flow: from the sizes of old shards and the room in new ones, the block transfers that move the fewest bytes.

Each old shard is cut into blocks by a hash of its rows, so that a block is a small part of what a new shard holds. What the driver gets is a row per
block, BLOCKS of them for a shard or one per BLOCK_BYTES, whichever are more: 6,144 for 24 shards of up to 1.5 TB, 400,000 for 100 TB.
A flow from old shards to new ones, in bytes, costs nothing where a shard keeps its number and 1 per byte elsewhere; blocks then go
where the flow says, the largest first, and a last step moves single blocks from the fullest shard to the emptiest until they differ by a
thousandth of a shard or no block is small enough. Blocks that are no small part of a shard are placed before the flow, which fills up what they leave.

Only shards that a block enters or leaves are written: each task writes one file of consecutive blocks of one shard, its rows in order of
(id, size, checksum), so places in a shard follow from the blocks' counts and the row's number in its file.

The law is ``bytes``: shards have nearly equal sizes, counts and keys do not matter. Equal texts are not kept together, since a third of all rows
may be copies of one text. A row's shard depends on the rows of the table, not on its files; only a block that is too large because one row is
repeated is dealt further by ``apart``, which tells equal rows from each other; without it they stay together.
Null texts have no bytes, null ids are an id of their own, a null old shard is none: its rows move, wherever they go. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import forget, fresh, shared_folder, written

SHARDS, OVERHEAD = 24, 8
BLOCKS, BLOCK_BYTES, FILE_BYTES = 256, 256 << 20, 128 << 20
#: A block is dealt further from so many times the usual bytes on.
TOO_LARGE = 4
#: Blocks over this part of a shard are placed before the flow. Shards may differ by this part of a shard.
PLACED_FIRST, TOLERANCE = 8, 1000
KEY = ("old", "bucket", "part", "copy")


def min_cost_flow(supply: np.ndarray, room: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The cheapest integer flow (rows: supplies, columns: rooms) that moves all supplies; by successive shortest paths in the residual graph."""
    supply, room = np.array(supply, dtype=np.int64), np.array(room, dtype=np.int64)
    if supply.sum() > room.sum():
        raise ValueError("there is less room than supply")
    flow, far = np.zeros(cost.shape, dtype=np.int64), np.int64(1) << 60
    while supply.any():
        row, came = np.where(supply > 0, 0, far), np.full(len(supply), -1)
        column, start = np.full(len(room), far), np.full(len(room), -1)
        while True:
            through = row[:, None] + cost
            nearer = through.min(axis=0) < column  # a tie keeps the way it has, or ways could run in a circle
            column[nearer], start[nearer] = through.min(axis=0)[nearer], through.argmin(axis=0)[nearer]
            back = np.where(flow > 0, column[None, :] - cost, far)
            shorter = back.min(axis=1) < row
            if not shorter.any():
                break
            row[shorter], came[shorter] = back.min(axis=1)[shorter], back.argmin(axis=1)[shorter]
        end = int(np.where(room > 0, column, far).argmin())
        path, at = [], end
        while True:
            path.append((start[at], at))
            if came[start[at]] < 0:
                break
            at = came[start[at]]
        amount = min([room[end], supply[path[-1][0]], *(flow[i, came[i]] for i, _ in path[:-1])])
        for i, j in path:
            flow[i, j] += amount
        for i, _ in path[:-1]:
            flow[i, came[i]] -= amount
        room[end] -= amount
        supply[path[-1][0]] -= amount
    return flow


@dataclass
class Layout:
    """Where each block goes: ``blocks`` are (old, bucket, part, copy, bytes, rows), ``shard`` their new shards; sizes and least bytes moved beside them."""

    blocks: list[tuple]
    shard: list[int]
    sizes: list[int]
    least_moved: int
    moved: int = 0
    transfers: dict[tuple[int, int], int] = field(default_factory=dict)

    def affected(self) -> set[int]:
        return {s for pair in self.transfers for s in pair}


def _levelled(load: list[int], total: int) -> np.ndarray:
    """Room in each shard, ``total`` in all, so that the lower ones are filled up to one level."""
    order = sorted(range(len(load)), key=lambda j: (load[j], j))
    room, left = np.zeros(len(load), dtype=np.int64), total
    for k in range(1, len(load) + 1):
        level = load[order[k]] if k < len(load) else None
        need = None if level is None else sum(level - load[j] for j in order[:k])
        if need is None or need >= left:
            base, extra = divmod(left + sum(load[j] for j in order[:k]), k)
            for i, j in enumerate(order[:k]):
                room[j] = base - load[j] + (i < extra)
            return room
    return room


def laid_out(blocks: list[tuple], shards: int) -> Layout:
    """Deal blocks to ``shards`` shards of nearly equal bytes, with as few bytes moved as that allows."""
    blocks = sorted(blocks)
    total, load, shard = sum(b[4] for b in blocks), [0] * shards, [-1] * len(blocks)
    fair = -(-total // shards)
    by_size = sorted(range(len(blocks)), key=lambda i: (-blocks[i][4], i))
    for i in by_size:
        old, size = blocks[i][0], blocks[i][4]
        if size * PLACED_FIRST <= fair:
            continue
        stays = 0 <= old < shards and (not load[old] or load[old] + size <= fair)
        shard[i] = old if stays else min(range(shards), key=lambda j: (load[j], j))
        load[shard[i]] += size
    small = [i for i in by_size if shard[i] < 0]
    olds = sorted({blocks[i][0] for i in small})
    supply = {o: 0 for o in olds}
    for i in small:
        supply[blocks[i][0]] += blocks[i][4]
    cost = np.array([[int(o != j) for j in range(shards)] for o in olds], dtype=np.int64).reshape(len(olds), shards)
    flow = min_cost_flow(np.array([supply[o] for o in olds], dtype=np.int64), _levelled(load, sum(supply.values())), cost)
    rest = {o: {int(j): int(flow[k, j]) for j in np.flatnonzero(flow[k])} for k, o in enumerate(olds)}
    for i in small:
        old = blocks[i][0]
        shard[i] = max(rest[old], key=lambda j: (rest[old][j], j == old, -j), default=old if 0 <= old < shards else 0)
        rest[old][shard[i]] = rest[old].get(shard[i], 0) - blocks[i][4]
        load[shard[i]] += blocks[i][4]
    _even_out(blocks, shard, load, fair)
    size_of: dict[int, int] = {}
    for b in blocks:
        size_of[b[0]] = size_of.get(b[0], 0) + b[4]
    out = Layout(blocks, shard, load, sum(max(0, n - (fair if 0 <= o < shards else 0)) for o, n in size_of.items()))
    for b, j in zip(blocks, shard, strict=True):
        if b[0] != j:
            out.moved += b[4]
            out.transfers[b[0], j] = out.transfers.get((b[0], j), 0) + b[4]
    return out


def _even_out(blocks: list[tuple], shard: list[int], load: list[int], fair: int) -> None:
    """Move a block at a time from the fullest shard to the emptiest, each move making their difference smaller."""
    own: list[list[tuple[int, int]]] = [[] for _ in load]
    for i, j in enumerate(shard):
        own[j].append((blocks[i][4], i))
    for x in own:
        x.sort()
    while True:
        a, b = max(range(len(load)), key=lambda j: (load[j], -j)), min(range(len(load)), key=lambda j: (load[j], j))
        apart = load[a] - load[b]
        if apart * TOLERANCE <= fair:
            return
        at = bisect.bisect_left(own[a], (apart // 2 + 1, -1))
        choice = [own[a][k] for k in (at - 1, at) if 0 <= k < len(own[a]) and 0 < own[a][k][0] < apart]
        if not choice:
            return
        size, i = min(choice, key=lambda x: (abs(2 * x[0] - apart), x[1]))
        own[a].remove((size, i))
        bisect.insort(own[b], (size, i))
        shard[i] = b
        load[a] -= size
        load[b] += size


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _sized(docs: DataFrame, old: Column, id_col: str, text_col: str, apart: Column | None) -> DataFrame:
    """id, size, crc, old, hash and apart of every row, and what else ``docs`` has as one struct."""
    text = _text(docs, text_col)
    size, crc = (F.octet_length(text) + OVERHEAD).cast("bigint"), F.crc32(text)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), size.alias("size"), crc.alias("crc"), F.coalesce(old.cast("int"), F.lit(-1)).alias("old"), (F.xxhash64(apart) if apart is not None else F.lit(0).cast("bigint")).alias("apart"))
    return rows.withColumn("hash", F.xxhash64("id", "size", "crc"))


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _blocked(rows: DataFrame, buckets: list[tuple], parts: list[tuple], copies: list[tuple]) -> DataFrame:
    """``rows`` with the key of their block. The three tables have a row per old shard, and per block that is dealt further."""
    spark = rows.sparkSession
    out = rows.join(_small(spark, buckets, "old int, n bigint"), "old").withColumn("bucket", F.pmod("hash", "n")).drop("n")
    for name, table, value in (("part", parts, F.xxhash64("hash", F.lit(1))), ("copy", copies, F.col("apart"))):
        keys = KEY[: KEY.index(name)]
        if table:
            found = _small(spark, table, "old int, " + ", ".join(f"{k} bigint" for k in keys[1:]) + ", n bigint")
            out = out.join(found, list(keys), "left").withColumn(name, F.coalesce(F.pmod(value, F.col("n")), F.lit(0))).drop("n")
        else:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
    return out


def planned(docs: DataFrame, old: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", apart: Column | None = None) -> tuple[Layout, tuple]:
    """The layout of ``docs`` in ``shards`` shards, and the tables that ``_blocked`` needs for it."""
    rows = _sized(docs, old, id_col, text_col, apart).drop("row", "id", "crc")
    light = written(rows, "sizes", "zstd")  # without texts; read three times
    sums = light.groupBy("old").agg(F.sum("size").alias("bytes")).collect()
    total = sum(r["bytes"] for r in sums)
    target = max(1, min(total // (shards * BLOCKS), BLOCK_BYTES))
    buckets = [(r["old"], -(-r["bytes"] // target)) for r in sums]
    parts: list[tuple] = []
    copies: list[tuple] = []
    for keys, further in ((KEY[:2], parts), (KEY[:3], copies)):
        found = _blocked(light, buckets, parts, copies).groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), (F.min("hash") == F.max("hash")).alias("same"))
        for r in found.where((F.col("bytes") > TOO_LARGE * target) & (F.col("rows") > 1) & ((F.lit(len(keys) == 2)) | F.col("same"))).collect() if buckets else []:
            further.append((*(r[k] for k in keys), min(r["rows"], -(-r["bytes"] // target))))
    found = _blocked(light, buckets, parts, copies).groupBy(*KEY).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect() if buckets else []
    forget(light)
    return laid_out([tuple(r[k] for k in (*KEY, "bytes", "rows")) for r in found], shards), (buckets, parts, copies)


def _files(layout: Layout, file_bytes: int) -> tuple[list[tuple], list[tuple]]:
    """Per block its file and place, and per file its first slot: a shard's blocks in order of their keys, in files of about ``file_bytes``."""
    places, files = [], []
    order = sorted(range(len(layout.blocks)), key=lambda i: (layout.shard[i], layout.blocks[i]))
    shard = size = slot = 0
    for n, i in enumerate(order):
        block, own = layout.blocks[i], layout.shard[i]
        if not n or own != shard or size and size + block[4] > file_bytes:
            slot = 0 if not n or own != shard else slot
            shard, size = own, 0
            files.append((len(files), slot))
        places.append((*block[:4], own, len(files) - 1, n))
        size += block[4]
        slot += block[5]
    return places, files


def resharded(docs: DataFrame, old: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", apart: Column | None = None, path: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, Layout]:
    """``docs`` with shard and slot, read from the files of the shards that changed, at ``path``/shard=k (default: a new shared folder); and the layout.

    Rows of a shard that nothing enters or leaves are taken from ``docs``, and nothing is written for them. The new columns come last, with underscores before names that ``docs`` has.
    """
    spark = docs.sparkSession
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    layout, tables = planned(docs, old, shards, id_col, text_col, apart)
    own = [F.col(f"row.`{c}`") for c in docs.columns]
    if not layout.blocks:
        return docs.limit(0).select("*", F.lit(0).alias(shard), F.lit(0).cast("bigint").alias(slot)), layout
    places, files = _files(layout, file_bytes)
    rows = _blocked(_sized(docs, old, id_col, text_col, apart), *tables)
    rows = rows.join(_small(spark, places, "old int, bucket bigint, part bigint, copy bigint, shard int, file int, place int"), list(KEY))

    def placed(part: DataFrame, files: list[tuple]) -> DataFrame:
        """One task per file; rows sorted, and numbered on from the file's first slot."""
        number = {f: k for k, (f, _) in enumerate(files)}
        dealt = part.join(_small(spark, [(f, number[f], first) for f, first in files], "file int, task int, first bigint"), "file")
        dealt = dealt.repartitionById(len(files), F.col("task")).sortWithinPartitions("shard", "place", "id", "size", "crc")
        at = F.col("first") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        return dealt.select(*own, F.col("shard").alias(shard), at.alias(slot))

    changed = layout.affected()
    of = {f: s for *_, s, f, _ in places}
    new, same = ([x for x in files if (of[x[0]] in changed) == flag] for flag in (True, False))
    out = []
    if new:
        path = path or shared_folder(spark, "shards")
        part = placed(rows.where(F.col("shard").isin(*changed)) if same else rows, new)
        part.write.mode("overwrite").option("compression", "zstd").partitionBy(shard).parquet(path)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
        out.append(spark.read.schema(part.schema).parquet(path).select(*(F.col(f"`{c}`") for c in part.columns)))
    if same:
        out.append(placed(rows.where(~F.col("shard").isin(*changed)) if new else rows, same))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1]), layout


def report(docs: DataFrame, old: Column, apart: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """Per document its size, checksum, shard and slot, from the rewritten files."""
    rows, _ = resharded(docs, old, shards, apart=apart)
    text = _text(rows, "text")
    return rows.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), F.col(rows.columns[-2]).alias("shard"), F.col(rows.columns[-1]).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

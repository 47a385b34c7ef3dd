"""Training-order materialisation: every packed sequence gets a global slot by a keyed permutation, and slots lie in fixed-stride shards.

Sequences are numbered densely from 0 to n - 1 by their task's share and place. A balanced Feistel network over the smallest even number of bits
that holds n permutes numbers under a key; a result of n or more is encrypted again until it is below (cycle-walking), which makes
the network a permutation of the n slots. So a slot is a function of number, key and n, no shuffle list is kept, and the inverse tells which
sequence a slot holds. Tasks own ranges of whole shards by arithmetic, with no sampling, and sort their slots. A shard is ``per_shard``
records of equal length: ids, padded, and a marker that Spark's text writer puts after each record. Reading on from slot s means shard
s // per_shard from byte s % per_shard times the stride.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm.common import collected, mapped, schema_with, shared_folder
from lintmill.llm.packing import CAPACITY, ENCODE_ROWS, Encoder, Packer

PER_SHARD, ROUNDS, PAD_ID = 4096, 6, 0
MARKER = "\r\n\r\n"
KEY = "lintmill"
PARTITION_BITS = 36
#: Shards are written in so many ranges one after the other, so that the shuffle on disk is a part of the data only.
PASSES = 3


class Feistel:
    """A permutation of 0 .. n - 1 under a key."""

    def __init__(self, n: int, key: str = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(rounds)]
        self.mask = np.uint64((1 << self.half) - 1)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64], inverse: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = (right ^ self._mixed(left, k), left) if inverse else (right, left ^ self._mixed(right, k))
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        keys = self.keys[::-1] if inverse else self.keys
        out = self._once(np.asarray(x, dtype=np.uint64), keys, inverse)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], keys, inverse)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


class _Sequences(Packer):
    """Whole padded sequences instead of pieces."""

    def __init__(self, partition: int, capacity: int, kind: str):
        super().__init__(partition, capacity)
        self.kind = kind

    def _sequence(self, pieces) -> None:
        ids = np.frombuffer(b"".join(p[0][2] for p in pieces), dtype="<u4")
        if len(ids) and int(ids.max()) >> 8 * np.dtype(self.kind).itemsize:
            raise ValueError(f"id {ids.max()} does not fit {np.dtype(self.kind).itemsize} bytes; set id_bytes")
        padded = np.full(self.capacity, PAD_ID, dtype=self.kind)
        padded[: len(ids)] = ids
        self.rows.append((self.next_sequence, len(ids), padded.tobytes()))
        self.next_sequence += 1


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, length, ids): packed documents as padded sequences of ids of ``id_bytes`` bytes each."""

    def run(batches):
        packer, encoder = _Sequences(TaskContext.get().partitionId(), capacity, f"<u{id_bytes}"), Encoder(tokenizer_path)

        def out():
            columns = list(zip(*packer.rows, strict=True)) or [[], [], []]
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["sequence_id", "length", "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                for ids in encoder.encode(batch.column(0).slice(at, ENCODE_ROWS)):
                    packer.add(None, ids)
                if len(packer.rows) >= 1024:
                    yield out()
        packer.close()
        yield out()

    return mapped(docs.select(F.col(text_col).cast("string")), run, "sequence_id bigint, length bigint, ids binary")


def slotted(packed: DataFrame, key: str = KEY) -> tuple[DataFrame, int]:
    """``packed`` with its global slot, and the number of sequences. What is collected is a row per task that packed."""
    counts = {r["p"]: r["n"] for r in packed.groupBy(F.shiftright("sequence_id", PARTITION_BITS).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    permutation = Feistel(max(total, 1), key)
    first = np.array([starts.get(p, 0) for p in range(max(starts, default=0) + 1)], dtype=np.int64)

    at = packed.columns.index("sequence_id")

    def run(batches):
        for batch in batches:
            x = batch.column(at).to_numpy()
            slot = permutation.slot(first[x >> PARTITION_BITS] + (x & ((1 << PARTITION_BITS) - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], names=[*batch.schema.names, "slot"])

    return mapped(packed, run, schema_with(packed, "slot bigint")), total


def write_shards(rows: DataFrame, total: int, path: str, per_shard: int = PER_SHARD, passes: int = PASSES) -> None:
    """Write (slot, ids) as one file per shard under ``path``/shard=k, a range of shards at a time."""
    shards = -(-total // per_shard)
    tasks = max(1, min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = rows.select("slot", "ids", F.floor(F.col("slot") / per_shard).alias("shard"))
    bounds = sorted({shards * k // passes for k in range(passes + 1)})
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = own.where((F.col("shard") >= low) & (F.col("shard") < high))
        task = F.floor((F.col("shard") - low) * tasks / (high - low)).cast("int")
        part = part.repartitionById(tasks, task).sortWithinPartitions("shard", "slot").select("shard", F.col("ids").cast("string").alias("value"))
        part.write.mode("append" if low else "overwrite").partitionBy("shard").option("lineSep", MARKER).text(path)
        collected(rows.sparkSession)


def read_shards(spark: SparkSession, path: str, capacity: int = CAPACITY, id_bytes: int = 2, per_shard: int = PER_SHARD, start: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, ids_crc32, ids) of the records from slot ``start`` on; shards before it are not opened. The sum is over the ids as 32-bit integers."""
    stride = capacity * id_bytes + len(MARKER)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("shard") >= start // per_shard)

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                if len(data) % stride:
                    raise ValueError(f"shard {shard} has no whole number of records")
                first = max(0, start - shard * per_shard) if shard == start // per_shard else 0
                at = range(first * stride, len(data), stride)
                ids = [data[i : i + stride - len(MARKER)] for i in at]
                sums = [zlib.crc32(np.frombuffer(x, dtype=f"<u{id_bytes}").astype("<u4").tobytes()) for x in ids]
                slots = [shard * per_shard + i // stride for i in at]
                columns = [pa.array(slots, pa.int64()), pa.array([shard] * len(ids), pa.int64()), pa.array(list(at), pa.int64()), pa.array(sums, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "byte_offset", "ids_crc32", "ids"])

    return mapped(files.select(F.col("shard").cast("bigint"), "content"), run, "slot bigint, shard bigint, byte_offset bigint, ids_crc32 bigint, ids binary")


def materialise(docs: DataFrame, tokenizer_path: str, *, key: str = KEY, per_shard: int = PER_SHARD, capacity: int = CAPACITY, id_bytes: int = 2, path: str | None = None) -> DataFrame:
    """Documents as packed sequences in training order, written as shards at ``path`` (default: a new shared folder), and what the shards hold.

    A vocabulary of more than 65,536 ids needs an ``id_bytes`` of 4; an id that does not fit is an error.
    A null text is the end id alone; repeated rows count each by itself; an empty table writes no shard and gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "shards")
    store = shared_folder(spark, "sequences")
    made = sequences(docs, tokenizer_path, capacity, id_bytes)
    made.write.option("compression", "zstd").parquet(store)
    for x in (path, store):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(x)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    rows, total = slotted(spark.read.schema(made.schema).parquet(store), key)
    if not total:
        return spark.createDataFrame([], "slot bigint, shard bigint, byte_offset bigint, ids_crc32 bigint, ids binary")
    write_shards(rows, total, path, per_shard)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(store)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return read_shards(spark, path, capacity, id_bytes, per_shard)

"""Benchmark decontamination with training suffix arrays.

The training text is cut into shards, whole documents of about ``SHARD_BYTES`` each. A shard becomes an array of word
numbers in the order of the benchmark's own words (0 for a word that no benchmark item has), and a suffix array over it:
its positions sorted by the words that follow, to the depth of a window. Positions from which no match of the least
length can start, because a foreign word is too near, are left out. Every test suffix is looked up by two binary searches for its
first ``window`` words, which give all locations; neighbouring hits on one diagonal join to the longest verbatim match.

A document is never split, so that no shard depends on another and nothing is shuffled. A benchmark of at most ``BLOCK_BYTES`` is broadcast. A
larger one is dealt to blocks of about that size by the hashes of its ids; one block at a time is broadcast and dropped again, its hits are
written, and the hits of all blocks are joined with the documents at the end.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import binaries, fresh, mapped, slices, spread_join, written

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
FOUND = (
    "__n_words bigint, __spans array<struct<start:bigint,end:bigint>>, __items array<string>, "
    "__matches array<struct<item_id:string,item_start:int,doc_start:bigint,n_words:int>>"
)

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(_WORD).split()


class Benchmark:
    """The windows of some test items, numbered by their own vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        cut = [(name, words(text)) for name, text in sorted(items, key=lambda x: (x[0].encode(), x[1]))]
        self.names = [name for name, w in cut if w]
        cut = [w for _, w in cut if w]
        rank = {name: i for i, name in enumerate(dict.fromkeys(self.names))}
        self.rank = np.array([rank[name] for name in self.names], dtype=np.int64)
        self.vocabulary = {w: i for i, w in enumerate(sorted({x for w in cut for x in w}), 1)}
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = max(1, 63 // self.bits)
        at: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for item, w in enumerate(cut):
            ids, m = np.fromiter(map(self.vocabulary.__getitem__, w), dtype=np.int32, count=len(w)), min(window, len(w))
            at[m].append((np.lib.stride_tricks.sliding_window_view(ids, m), (item << 32) + np.arange(len(ids) - m + 1)))
        self.lengths, self.windows, self.first = sorted(at), {}, {}
        owners, sizes, before = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
        for m in self.lengths:
            self.windows[m], which = np.unique(np.concatenate([x for x, _ in at[m]]), axis=0, return_inverse=True)
            owners.append(np.concatenate([x for _, x in at[m]])[np.argsort(which.ravel(), kind="stable")])
            sizes.append(np.bincount(which.ravel()))
            self.first[m], before = before, before + len(self.windows[m])
        self.owned, self.bound = np.concatenate(owners), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def owners(self, q: int) -> np.ndarray:
        """Where items have window q: the item's number in the high half, the place in the low half, ascending."""
        return self.owned[self.bound[q] : self.bound[q + 1]]

    def keys(self, ids: np.ndarray, n: int) -> np.ndarray:
        """For each of the first n positions, the next ``per_key`` word numbers packed into one integer."""
        key = np.zeros(n, dtype=np.int64)
        for j in range(self.per_key):
            key = (key << self.bits) | ids[j : j + n]
        return key

    def search(self, ids: np.ndarray) -> np.ndarray:
        """Rows (location, length, number of the window) of every window of every item in the shard ``ids``."""
        none = np.zeros((0, 3), dtype=np.int64)
        if not self.lengths or not len(ids):
            return none
        least, depth = self.lengths[0], self.lengths[-1]
        levels = -(-depth // self.per_key)
        n, padded = len(ids), np.concatenate([ids, np.zeros(levels * self.per_key + depth, dtype=np.int64)])
        known = padded != 0
        start_ok = known[:n].copy()
        for j in range(1, least):
            start_ok &= known[j : j + n]
        positions = np.flatnonzero(start_ok)
        if not len(positions):
            return none
        key = self.keys(padded, n + (levels - 1) * self.per_key)
        columns = [key[positions + level * self.per_key] for level in range(levels)]
        order = np.lexsort(columns[::-1])
        suffixes, columns = positions[order], [c[order] for c in columns]
        found = [none]
        for m in self.lengths:
            low = self._packed(self.windows[m], levels, 0)
            high = self._packed(self.windows[m], levels, (1 << self.bits) - 1)
            first, last = self._bisect(columns, low, False), self._bisect(columns, high, True)
            for q in np.flatnonzero(last > first):
                where = suffixes[first[q] : last[q]]
                found.append(np.column_stack([where, np.full(len(where), m), np.full(len(where), self.first[m] + q)]))
        return np.concatenate(found)

    def _packed(self, windows: np.ndarray, levels: int, fill: int) -> list[np.ndarray]:
        wide = np.full((len(windows), levels * self.per_key), fill, dtype=np.int64)
        wide[:, : windows.shape[1]] = windows
        out = []
        for level in range(levels):
            key = np.zeros(len(windows), dtype=np.int64)
            for j in range(self.per_key):
                key = (key << self.bits) | wide[:, level * self.per_key + j]
            out.append(key)
        return out

    @staticmethod
    def _bisect(columns: list[np.ndarray], query: list[np.ndarray], right: bool) -> np.ndarray:
        low = np.zeros(len(query[0]), dtype=np.int64)
        high = np.full(len(query[0]), len(columns[0]), dtype=np.int64)
        while (live := low < high).any():
            mid = np.where(live, (low + high) >> 1, 0)
            before, same = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
            for c, q in zip(columns, query, strict=True):
                before |= same & (c[mid] < q)
                same &= c[mid] == q
            before = (before | same) if right else before
            low = np.where(live & before, mid + 1, low)
            high = np.where(live & ~before, mid, high)
        return low


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _longest(hits: np.ndarray, bench: Benchmark) -> list[tuple[str, int, int, int]]:
    """Rows (item, item start, document start, words): hits that follow each other in one item are one match, and none lies within another.

    A hit that no match has yet is followed to the left as far as one of its items goes, and from there to the right; so every stretch that can't be
    longer is found once, without a row for every owner of a window that many items share. Of items with the same stretch the least id is named, at its
    first place. Which items are at hand decides nothing else, so ``uncovered`` gives the same for all blocks of a benchmark together.
    """
    out = []
    for m in np.unique(hits[:, 1]).tolist():
        own = hits[hits[:, 1] == m]
        own = own[np.argsort(own[:, 0])]
        where, owners = own[:, 0].tolist(), [bench.owners(q) for q in own[:, 2].tolist()]
        i = 0
        while i < len(where):
            active, k = owners[i], i
            while k and where[k - 1] == where[k] - 1 and len(more := np.intersect1d(active - 1, owners[k - 1], assume_unique=True)):
                active, k = more, k - 1
            active, j = active + (i - k), i
            while j + 1 < len(where) and where[j + 1] == where[j] + 1 and len(more := np.intersect1d(active + 1, owners[j + 1], assume_unique=True)):
                active, j = more, j + 1
            active = active - (j - k)
            rank = bench.rank[active >> 32]
            first = active[rank == rank.min()]
            out.append((bench.names[int(first[0]) >> 32], int((first & 0xFFFFFFFF).min()), where[k], where[j] + m - where[k]))
            i = j + 1
    return uncovered(out)


def uncovered(matches: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The matches that lie in no other one, one of each stretch, in the order of the document."""
    out, end = [], -1
    for x in sorted(matches, key=lambda x: (x[2], -x[3], x[0].encode(), x[1])):
        if x[2] + x[3] > end:
            out.append(x)
            end = x[2] + x[3]
    return out


def scan(texts: list[bytes | None], bench: Benchmark, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, list, list, list]]:
    """For each text: its words, the merged word spans that are hit, the items found, and the longest matches."""
    out: list[tuple[int, list, list, list]] = []
    get = bench.vocabulary.get
    for lo, hi in slices(texts, shard_bytes):
        parts, counts = [], []
        for text in texts[lo:hi]:
            w = words(text) if text else []
            counts.append(len(w))
            parts += [np.fromiter(map(get, w, repeat(0)), dtype=np.int64, count=len(w)), np.zeros(1, dtype=np.int64)]
        begin = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)])
        hits = bench.search(np.concatenate(parts))
        doc = np.searchsorted(begin, hits[:, 0], side="right") - 1
        by_doc = np.argsort(doc, kind="stable")
        hits, doc = hits[by_doc], doc[by_doc]
        edge = np.searchsorted(doc, np.arange(hi - lo + 1))
        for k, n in enumerate(counts):
            own = hits[edge[k] : edge[k + 1]]
            if not len(own):
                out.append((n, [], [], []))
                continue
            own = own - np.array([begin[k], 0, 0])
            items = {i for q in np.unique(own[:, 2]).tolist() for i in np.unique(bench.owners(q) >> 32).tolist()}
            out.append((n, _merged(own[:, 0], own[:, 0] + own[:, 1]), sorted({bench.names[i] for i in items}), _longest(own, bench)))
    return out


_FIELDS = [x.strip().split(" ", 1) for x in FOUND.split(", ")]


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    """Spans, items and matches of scanned texts."""
    spans = [[{"start": s, "end": e} for s, e in r[1]] for r in rows]
    matches = [[dict(zip(("item_id", "item_start", "doc_start", "n_words"), m, strict=True)) for m in r[3]] for r in rows]
    return [pa.array(x, type=kind) for x, kind in zip((spans, [r[2] for r in rows], matches), kinds, strict=True)]


def _loaded(items: DataFrame, window: int):
    """The broadcast index of some test items."""
    return items.sparkSession.sparkContext.broadcast(Benchmark([(r[0], bytes(r[1])) for r in items.collect()], window))


def _in_one(docs: DataFrame, items: DataFrame, text_col: str, window: int, names: list[str]) -> DataFrame:
    shared, at = _loaded(items, window), docs.columns.index(text_col)
    empty = [F.lit(0).cast("bigint"), *(F.expr(f"cast(array() as {kind})") for _, kind in _FIELDS[1:])]
    out = docs.select("*", *(e.alias(n) for e, n in zip(empty, names, strict=True)))

    def look(batches):
        for batch in batches:
            rows = scan(binaries(batch.column(at)), shared.value)
            found = [pa.array([r[0] for r in rows], pa.int64()), *_columns(rows, [c.type for c in batch.columns[-3:]])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *found], schema=batch.schema)

    return mapped(out, look, out.schema)


def _in_blocks(docs: DataFrame, items: DataFrame, blocks: int, text_col: str, window: int, names: list[str]) -> DataFrame:
    spark, text = docs.sparkSession, F.col(f"`{text_col}`").cast("string")
    dealt = written(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "benchmark")
    texts = docs.where(text.isNotNull()).select(F.unhex(F.sha1(text.cast("binary"))).alias("key"), text.alias("text"))
    shape = ", ".join(f"{n[2:]} {kind}" for n, kind in _FIELDS[1:])
    hits = None
    for block in range(blocks):
        shared = _loaded(dealt.where(F.col("block") == block).select("item", "body"), window)
        kinds = [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int64()), ("n_words", pa.int32())]))]

        def look(batches, shared=shared, kinds=kinds):
            for batch in batches:
                rows = scan(binaries(batch.column(1)), shared.value)
                hit = np.flatnonzero([bool(r[1]) for r in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), *_columns([rows[i] for i in hit], kinds)], names=["key", "spans", "items", "matches"])

        # copies of one text have one row, made before the shuffle
        found = mapped(texts, look, f"key binary, {shape}").groupBy("key").agg(*(F.first(c).alias(c) for c in ("spans", "items", "matches")), F.count("*").alias("n"))
        found = written(found, "benchmark-hits")
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches")]  # of as many lists as blocks
    hits = written(hits.groupBy("key").agg(F.max("n").alias("n"), *lists), "benchmark-hits")

    def together(s):
        """Sorted spans, those that touch made one."""
        last = lambda a: F.element_at(a, -1)
        grown = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))
        return F.aggregate(F.array_sort(s), F.expr(f"cast(array() as {_FIELDS[1][1]})"), lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]), grown(a, x)).otherwise(F.concat(a, F.array(x))))

    def longest(found):
        """As ``uncovered``, over the matches of all blocks."""
        end = lambda x: x["doc_start"] + x["n_words"]
        ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["doc_start"].alias("s"), (-x["n_words"]).alias("l"), x["item_id"].alias("i"), x["item_start"].alias("p"), x.alias("x"))))
        grown = lambda a, x: F.when((F.size(a) > 0) & (end(F.try_element_at(a, F.lit(-1))) >= end(x)), a).otherwise(F.concat(a, F.array(x)))
        return F.aggregate(F.transform(ordered, lambda y: y["x"]), F.expr(f"cast(array() as {_FIELDS[3][1]})"), grown)

    key = fresh(docs, "key")
    hits = hits.select(F.col("key").alias(key), "n", together(F.col("spans")).alias(names[1]), F.array_sort(F.array_distinct("items")).alias(names[2]), longest(F.col("matches")).alias(names[3]))
    size = fresh(docs, "n")
    keyed = docs.withColumn(key, F.unhex(F.sha1(text.cast("binary"))))
    out = spread_join(keyed.where(F.col(key).isNotNull()), hits.withColumnRenamed("n", size), [key], docs.count(), size=size, how="left")
    out = out.unionByName(keyed.where(F.col(key).isNull()), allowMissingColumns=True)
    count = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), "")).cast("bigint")
    none = [F.coalesce(F.col(n), F.expr(f"cast(array() as {kind})")).alias(n) for n, (_, kind) in zip(names[1:], _FIELDS[1:], strict=True)]
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), count.alias(names[0]), *none)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with __n_words, __spans (merged spans of hit words), __items (ids found) and __matches (longest verbatim matches).

    A window is ``window`` consecutive words of an item, or the whole of a shorter item; items may have any length. Null and empty texts have no
    words and no matches; benchmark rows without id or text are left out; an empty benchmark hits nothing; repeated rows each get their own
    result, and items that repeat an id count once. An empty table gives no rows. All columns of ``docs`` pass through unchanged; if one has a name
    that is added here, the added one gets underscores before it, so they are best found as the last four columns.
    """
    names = [fresh(docs, n) for n, _ in _FIELDS]
    items = benchmark.where(F.col(f"`{item_id_col}`").isNotNull() & F.col(f"`{item_text_col}`").isNotNull())
    items = items.select(F.col(f"`{item_id_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").cast("binary").alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if size <= block_bytes:
        return _in_one(docs, items, text_col, window, names)
    return _in_blocks(docs, items, -(-size // block_bytes), text_col, window, names)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the matches with their places."""
    found = benchmark_matches(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (F.size("__items") > 0).alias("contaminated"),
        F.col("__matches").alias("matches"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any benchmark item, with their own columns."""
    found = benchmark_matches(docs, benchmark, **options)
    return found.where(F.size(found.columns[-2]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

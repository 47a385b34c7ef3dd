"""N-gram Jaccard join by signature trees, and the components of its links.

A text's set is its distinct ``k``-word shingles, as 64-bit hashes; two texts link when den * intersection >= num * union. A
signature tree sorts sets by size and signature into leaves of ``LEAF``; every node holds the OR of its sets' bitmaps, their size range and the
largest surplus of tokens over bits. Two trees, or one with itself, are traversed together. With c common bits, sets x below P
and y below Q share at most min(size, c + surplus) tokens, and a link needs a known part of their sizes; node pairs that cannot reach it are
pruned, and so are those whose sets are all in one component already. What is left at the leaves is compared exactly.

Trees are built where linked sets must meet. Linked sets share a token among the first n - ceil(num/den n) + 1 of each in any fixed order of
all tokens; here that is the hash order with the most frequent tokens last. Copies with equal sets are one set. Two cheap rounds
first bring sets with the same least or greatest shared token together with their texts, verify there and join most near copies.
Then only tokens between different components remain; groups over ``BLOCK`` become pairs of blocks, so that no task holds a whole group
and no link is lost. There a token's place in both prefixes bounds what the sets share from it on, which is all if it is the first they share,
and a pair that shares a token among its ``HEADS`` first ones is named there alone, not by each token it shares. Links are few; components come from alternating star steps, and every step's result is in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import binaries, collected, forget, fresh, mapped, spread_join, written
from lintmill.operators.order import numbered

WORDS, NUM, DEN = 5, 80, 100
SIGNATURE_BYTES, WIDE_BYTES = 64, 4096
LEAF, BLOCK, PIVOTS = 16, 1024, 16
#: A set's shared tokens that tell, at each other one, whether a pair was named already; and how many pairs are asked at once.
HEADS, PAIRS = 8, 8192
#: What a block's sets hold together, but for single larger sets.
BLOCK_TOKENS = 1 << 20
#: Components are found in files of so many edges, four at least.
EDGES_PER_FILE = 200_000
#: A token is frequent in so many documents, or in one of a thousand; at most so many go last.
FREQUENT, FREQUENT_LIMIT = 50, 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        # hashing a word anew costs less than looking it up in a large table
        values = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype="<u8")
        size = min(self.k, len(values))
        out = np.full(len(values) - size + 1, size, dtype=np.uint64)
        for j in range(size):
            out = (out ^ values[j : j + len(out)]) * _ODD
            out ^= out >> np.uint64(31)
        out *= _MIX
        return np.unique(out ^ (out >> np.uint64(29)))


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def signature(tokens: np.ndarray, n_bytes: int = SIGNATURE_BYTES) -> bytes:
    """A bitmap of the tokens; one of half the length is the OR of its halves."""
    bits = np.zeros(n_bytes * 8, dtype=bool)
    bits[(tokens >> np.uint64(17)) % np.uint64(len(bits))] = True
    return np.packbits(bits).tobytes()


def wide_bytes(n: int) -> int:
    """The length of a set's own wide bitmap: a power of two, some two bits or more per token within the bounds."""
    return min(max(SIGNATURE_BYTES, 1 << max(0, n - 1).bit_length() >> 2), WIDE_BYTES)


def wide_possible(n: int, a: bytes, m: int, b: bytes, num: int, den: int) -> bool:
    """Whether sets of n and m tokens can link, by their wide bitmaps folded to the shorter length."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    size = min(len(x), len(y))
    x, y = np.bitwise_or.reduce(x.reshape(-1, size)), np.bitwise_or.reduce(y.reshape(-1, size))
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return (num + den) * most >= num * (n + m)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    common = int(np.isin(a, b, assume_unique=True, kind="sort").sum()) if len(a) + len(b) < 64 else int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return den * common >= num * (len(a) + len(b) - common)


class Tree:
    """A signature tree over sets given by their sizes, bitmaps and, if known, the most that each can share. Level 0 has the sets themselves in leaf order."""

    def __init__(self, sizes: np.ndarray, signatures: np.ndarray, most: np.ndarray | None = None):
        self.order = np.lexsort((signatures[:, 1], signatures[:, 0], sizes))
        size, bits = sizes[self.order].astype(np.int64), signatures[self.order]
        surplus = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, surplus, size if most is None else most[self.order].astype(np.int64))]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, surplus, most = self.levels[-1]
            at = np.arange(0, len(bits), LEAF)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), *(np.maximum.reduceat(x, at) for x in (high, surplus, most))))


def possible(p: tuple, i: np.ndarray, q: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets below nodes i of level p and j of level q can link, by the largest overlap they can have."""
    common = np.bitwise_count(p[0][i] & q[0][j]).sum(1).astype(np.int64)
    most = np.minimum(np.minimum(p[4][i], q[4][j]), common + np.minimum(p[3][i], q[3][j]))
    fits = (den * p[2][i] >= num * q[1][j]) & (den * q[2][j] >= num * p[1][i])
    return fits & ((num + den) * most >= num * (p[1][i] + q[1][j]))


class Forest:
    """Union-find over the members of a block."""

    def __init__(self, start: list):
        first: dict = {}
        self.parent = [first.setdefault(c, i) for i, c in enumerate(start)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))])


def candidates(tree: Tree, other: Tree, num: int, den: int, label: np.ndarray, other_label: np.ndarray):
    """Yields arrays (i, j) of sets that may link and are in different components, leaf pair batches at a time.

    label: the components of the sets of each tree, by their own numbers; a tree may be traversed with itself.
    """
    same = tree is other
    height = max(len(tree.levels), len(other.levels)) - 1

    def ranges(labels: np.ndarray, t: Tree) -> list[tuple[np.ndarray, np.ndarray]]:
        low = high = labels[t.order]
        out = [(low, high)]
        for level in t.levels[1:]:
            at = np.arange(0, len(low), LEAF)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append((low, high))
        return out

    mine, theirs = ranges(label, tree), ranges(other_label, other)
    stack = [(height, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        depth, i, j = stack.pop()
        a, b = min(depth, len(tree.levels) - 1), min(depth, len(other.levels) - 1)
        p, q, (pl, ph), (ql, qh) = tree.levels[a], other.levels[b], mine[a], theirs[b]
        keep = possible(p, i, q, j, num, den) & ~((pl[i] == ph[i]) & (ql[j] == qh[j]) & (pl[i] == ql[j]))
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if depth == 0:
            yield tree.order[i], other.order[j]
            continue

        def children(x: np.ndarray, level: int, t: Tree) -> tuple[np.ndarray, np.ndarray]:
            if depth > len(t.levels) - 1:
                return x[:, None], np.ones((len(x), 1), dtype=bool)
            c = x[:, None] * LEAF + np.arange(LEAF)
            return c, c < len(t.levels[level - 1][0])

        for at in range(0, len(i), 256):
            ci, oi = children(i[at : at + 256], a, tree)
            cj, oj = children(j[at : at + 256], b, other)
            ok = oi[:, :, None] & oj[:, None, :]
            if same:
                ok &= ci[:, :, None] < cj[:, None, :] if depth == 1 else ci[:, :, None] <= cj[:, None, :]
            x, y, z = np.nonzero(ok)
            if len(x):
                stack.append((depth - 1, ci[x, y], cj[x, z]))


def named_before(token: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray, heads: np.ndarray, places: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether rows i and j, which meet at a ``token``, share a lesser one among their heads whose places let them link: they meet there too.

    Of the tokens that the places let a pair be named by, the least has no lesser one, so each pair is named at least there.
    """
    out = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        same = (heads[x][:, :, None] == heads[y][:, None, :]) & (heads[x] < token[x][:, None])[:, :, None]
        pair, a, b = np.nonzero(same)
        x, y = x[pair], y[pair]
        most = np.minimum(size[x] - places[x, a], size[y] - places[y, b])
        out[at + pair[(num + den) * most >= num * (size[x] + size[y])]] = True
    return out


def _groups(batches, key: tuple[str, ...]):
    """Tables of the rows that share a key; rows come sorted by it, a group may go over batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        changed[0] = True
        for name in key:
            values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(changed).tolist()
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            part = batch.slice(lo, hi - lo)
            own = tuple(part.column(part.schema.get_field_index(name))[0].as_py() for name in key)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _bitmaps(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype=np.uint64).reshape(len(signatures), -1)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(list(a), pa.int64()), pa.array(list(b), pa.int64())], names=["a", "b"])


def shingled(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n, key (hash of the set; null if empty), prefix, signature, wide. Without ``frequent``, the prefix is half as long again and in hash order."""
    schema = "doc_id bigint, text_hash bigint, n bigint, key binary, prefix array<bigint>, signature binary, wide binary"

    def run(batches):
        shingles = Shingler(k)
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for batch in batches:
            n, keys, prefixes, signatures, wides = [], [], [], [], []
            for text in binaries(batch.column(2)):
                tokens = shingles(text)
                n.append(len(tokens))
                keys.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                size = prefix_size(len(tokens), num, den)
                if frequent is None:
                    prefixes.append(tokens[: size + size // 2].view(np.int64))
                    signatures.append(None)
                    wides.append(None)
                else:
                    if len(frequent) and len(tokens):
                        hot = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
                        ordered = np.concatenate([tokens[~hot], tokens[hot]])[:size]
                    else:
                        ordered = tokens[:size]
                    prefixes.append(ordered.view(np.int64))
                    signatures.append(signature(tokens))
                    wides.append(signature(tokens, wide_bytes(len(tokens))))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(signatures, pa.binary()), pa.array(wides, pa.binary())], names=names)

    text = F.col(f"`{text_col}`").cast("string")
    return mapped(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text), run, schema)


def frequent_tokens(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> np.ndarray:
    """The tokens that go last, sorted: at most ``FREQUENT_LIMIT``, counted over all documents. They change the work, never the links."""
    bound = max(FREQUENT, docs.count() // 1000)
    low = shingled(docs, k, num, den, None, id_col, text_col).select(F.explode("prefix").alias("token"))
    found = low.groupBy("token").count().where(F.col("count") >= bound).orderBy(F.desc("count"), "token").limit(FREQUENT_LIMIT).select("token").toArrow()
    return np.sort(found["token"].to_numpy().astype(np.int64).view(np.uint64))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b) reaches. Alternating large-star and small-star steps.

    An id with very many neighbours is a hot key of both joins, whose other side has one row for each id.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    old = state(edges)
    files = old[0] // EDGES_PER_FILE + 4
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least, ["u"], 2 * old[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large.coalesce(files), "edges")
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, lower, ["u"], old[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct()
        new = written(small.coalesce(files), "edges")
        forget(edges, large)
        edges, now = new, state(new)
        if now == old:
            break
        old = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their rep so far."""
    if labels is None:
        return rows.withColumn("component", F.col("rep"))
    joined = rows.join(labels.withColumnRenamed("component", "__c"), rows.rep == F.col("id"), "left")
    return joined.withColumn("component", F.coalesce("__c", "rep")).drop("__c", "id")


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key has more than one component, with the key's rows and tokens as ``size`` and ``tokens``; ``rows`` are written ones."""
    stats = rows.groupBy(key).agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), F.min("component").alias("__lo"), F.max("component").alias("__hi"))
    return spread_join(rows, stats.where("__lo <> __hi").drop("__lo", "__hi"), [key], rows.count(), "size")


def _parts() -> Column:
    """How many parts a group of ``size`` sets with ``tokens`` tokens is dealt to."""
    return F.ceil(F.greatest(F.col("size") / BLOCK, F.col("tokens") / BLOCK_TOKENS)).cast("int")


def round_links(active: DataFrame, key: str, labels: DataFrame | None, k: int, num: int, den: int) -> DataFrame:
    """Links among sets with one ``key``, a block at a time: whole small groups, and parts of large ones that share some pivots."""
    light = _mixed(written(_labelled(active.where(F.col(key).isNotNull()).select("rep", key, "n"), labels), "light"), key)
    parts = _parts()
    draw = F.pmod(F.xxhash64("rep", F.lit(key)), F.col("size"))
    part = F.when(parts == 1, F.array(F.lit(0))).when(draw < PIVOTS, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), parts).cast("int")))
    light = light.select("rep", key, "component", F.explode(part).alias("part"))
    rows = light.join(active.select("rep", "n", "signature", "text"), "rep").select(key, "part", "rep", "component", "n", "signature", "text")
    rows = rows.repartition(key, "part").sortWithinPartitions(key, "part", "rep")

    def run(batches):
        shingles = Shingler(k)
        for group in _groups(batches, (key, "part")):
            rep, start = group["rep"].to_pylist(), group["component"].to_pylist()
            sizes, maps = group["n"].to_numpy(), _bitmaps(group["signature"].to_pylist())
            texts, sets, forest, out = group["text"], {}, Forest(start), []
            tree, label = Tree(sizes, maps), Forest(start).labels()

            def tokens(i: int, texts=texts, sets=sets) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingles((texts[i].as_py() or "").encode())
                return sets[i]

            for left, right in candidates(tree, tree, num, den, label, label):
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    if forest.find(i) != forest.find(j) and links(tokens(i), tokens(j), num, den):
                        forest.join(i, j)
                        out.append((rep[i], rep[j]))
            yield _pairs(out)

    return mapped(rows, run, "a bigint, b bigint")


def candidate_pairs(shared: DataFrame, active: DataFrame, labels: DataFrame | None, num: int, den: int) -> DataFrame:
    """Distinct pairs of sets in different components that share a token and may link by the trees' bounds and the token's place in both."""
    return named_pairs(shared, active, labels, num, den).distinct()


def named_pairs(shared: DataFrame, active: DataFrame, labels: DataFrame | None, num: int, den: int) -> DataFrame:
    """``candidate_pairs``, of which few come more than once."""
    labelled = written(_labelled(shared, labels), "labelled")
    mixed = written(_mixed(labelled.withColumn("n", F.lit(0)), "token"), "mixed")
    forget(labelled)
    # tokens in the first places are those that two sets of about one size can be named by
    late = (num + den) * F.col("place") > (den - num) * F.col("n")
    sized = mixed.select("rep", "token", "place").join(active.select("rep", "n"), "rep")
    heads = sized.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct(late.alias("late"), "token", "place"))), 1, HEADS).alias("h"))  # of one set's prefix
    heads = heads.select("rep", F.col("h.token").alias("heads"), F.col("h.place").alias("places"))
    rows, parts = mixed, _parts()
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(x, own).alias("p"), F.greatest(x, own).alias("q")))
    rows = rows.select("token", "rep", "place", "component", own.alias("own"), F.explode(F.when(parts == 1, F.array(F.struct(own.alias("p"), own.alias("q")))).otherwise(pair)).alias("x"))
    rows = rows.join(active.select("rep", "n", "signature").join(heads, "rep"), "rep").select("token", F.col("x.p").alias("p"), F.col("x.q").alias("q"), "own", "rep", "place", "component", "n", "signature", "heads", "places")
    rows = rows.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "rep")

    def first_tokens(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The heads of the rows and their places, HEADS each; what is missing is greater than all tokens, or equal to the greatest."""
        out = []
        for name, empty, kind in (("heads", np.iinfo(np.int64).max, np.int64), ("places", 0, np.int64)):
            column = rows.column(name)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            length = column.value_lengths().to_numpy()
            table = np.full((len(length), HEADS), empty, dtype=kind)
            table[np.arange(HEADS) < length[:, None]] = column.flatten().to_numpy()
            out.append(table)
        return out[0], out[1]

    def small(batch: pa.RecordBatch) -> tuple[pa.RecordBatch | None, np.ndarray]:
        """The pairs of groups that are one leaf and lie in the batch's middle, for all of them at once, and which rows are left."""
        names = ("token", "p", "q", "rep", "place", "n", "component")
        token, p, q, rep, place, n, component = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names)
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(token)))
        inner = (sizes <= LEAF) & (p[starts] == q[starts])
        inner[[0, -1]] = False
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for size in range(2, LEAF + 1):
            at = starts[inner & (sizes == size)]
            if len(at):
                i, j = np.triu_indices(size, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
        i, j = np.concatenate(left), np.concatenate(right)
        keep = component[i] != component[j]
        i, j = i[keep], j[keep]
        rest = ~np.repeat(inner, sizes)
        if not len(i):
            return None, rest
        maps = _bitmaps(batch.column(batch.schema.get_field_index("signature")).to_pylist())
        size = n.astype(np.int64)
        level = (maps, size, size, size - np.bitwise_count(maps).sum(1), size - place)
        keep = possible(level, i, level, j, num, den)
        i, j = i[keep], j[keep]
        keep = ~named_before(token, i, j, size, *first_tokens(batch), num, den)
        a, b = rep[i[keep]], rep[j[keep]]
        pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]), rest

    def run(batches):
        ready = []

        def large():
            for batch in batches:
                if batch.num_rows:
                    pairs, rest = small(batch)
                    if pairs is not None:
                        ready.append(pairs)
                    yield batch.filter(pa.array(rest))

        for group in _groups(large(), ("token", "p", "q")):
            yield from ready
            ready.clear()
            rep, own = group["rep"].to_numpy(), group["own"].to_numpy()
            sizes, maps, label = group["n"].to_numpy().astype(np.int64), _bitmaps(group["signature"].to_pylist()), group["component"].to_numpy()
            token, most, firsts = group["token"].to_numpy(), sizes - group["place"].to_numpy(), first_tokens(group)
            p, q = group["p"][0].as_py(), group["q"][0].as_py()
            sides = [np.flatnonzero(own == x) for x in ((p,) if p == q else (p, q))]
            trees = [Tree(sizes[s], maps[s], most[s]) for s in sides if len(s)]
            if len(trees) < len(sides):
                continue
            first, last = sides[0], sides[-1]
            for i, j in candidates(trees[0], trees[-1], num, den, label[first], label[last]):
                i, j = first[i], last[j]
                keep = label[i] != label[j]
                i, j = i[keep], j[keep]
                keep = ~named_before(token, i, j, sizes, *firsts, num, den)
                a, b = rep[i], rep[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])
        yield from ready

    return mapped(rows, run, "a bigint, b bigint")


def narrowed(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that can still link by bitmaps as wide as their sets need."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "wa", "nb", "wb")

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield _pairs([(a, b) for a, b, n, x, m, y in zip(*columns, strict=True) if wide_possible(n, x, m, y, num, den)])

    return mapped(rows, run, "a bigint, b bigint")


def verified(pairs: DataFrame, active: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that link, by their whole sets."""
    rows = pairs.join(active.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(active.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        shingles = Shingler(k)
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), binaries(batch.column(3)), strict=True):
                if links(shingles(ta), shingles(tb), num, den):
                    out.append((a, b))
            yield _pairs(out)

    return mapped(rows.select("a", "b", "ta", "tb"), run, "a bigint, b bigint")


def same_ids(every: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of ids that have more than one set."""
    named = every.where("key is not null and doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("key").alias("__lo"), F.max("key").alias("__hi"), F.count("*").alias("n")).where("__lo <> __hi").select("doc_id", "n")
    own = spread_join(named.select("doc_id", "key"), several, ["doc_id"], every.count()).select("doc_id", "key").distinct().join(reps.select("key", "rep"), "key")
    own = own.select("doc_id", "rep")
    least = own.groupBy("doc_id").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    return spread_join(own, least, ["doc_id"], every.count()).where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))


def jaccard_components(docs: DataFrame, *, k: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): per document the size of its set and the smallest id that it reaches by links.

    Null texts and texts without words have empty sets and link with nothing; a text of fewer than k words is one shingle. Sets are
    compared as sets of 64-bit hashes. Rows that repeat an id and a text each get a row. An id with different texts is one document with several
    sets: all their links count, and join each other by the id. A null id gets the component of
    an equal text with an id, else null. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    frequent = frequent_tokens(docs, k, num, den, id_col, text_col)
    collected(spark)
    every = written(shingled(docs, k, num, den, frequent, id_col, text_col), "sets")
    same = every.where("key is not null and doc_id is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("signature").alias("signature"), F.first("wide").alias("wide")
    )
    reps = written(same.select("key", F.col("first.doc_id").alias("rep"), F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("text_hash"), "n", "prefix", "signature", "wide"), "reps")
    twice = reps.groupBy("rep").agg(F.min("key").alias("least"), F.count("*").alias("times")).where("times > 1").drop("times")
    if not twice.isEmpty():  # a set whose least id stands for another set gets a number above all ids
        top = reps.agg(F.max("rep")).first()[0]
        named = numbered(reps.join(twice, "rep").where("key <> least").select("key"), "key").select("key", "place")
        reps = written(reps.join(named, "key", "left").withColumn("rep", F.coalesce(F.col("place") + top, "rep")).drop("place"), "reps")
    edges = written(same_ids(every, reps), "links")
    labels = None if edges.isEmpty() else components(edges)
    sets = written(every.select("doc_id", "n", "key"), "members")
    forget(every)
    collected(spark)
    tokens = reps.select("rep", F.posexplode("prefix").alias("place", "token"))
    shared = written(tokens.join(tokens.groupBy("token").count().where("count > 1").select("token"), "token").select("token", "rep", "place"), "shared")
    collected(spark)
    ends = shared.groupBy("rep").agg(F.min("token").alias("k1"), F.max("token").alias("k2"))
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    active = written(ends.join(reps.select("rep", "id", "text_hash", "n", "signature"), "rep").join(texts, ["id", "text_hash"]).dropDuplicates(["rep"]).drop("id"), "active")
    collected(spark)
    for key in ("k1", "k2"):
        edges = edges.union(written(round_links(active, key, labels, k, num, den), "links"))
        labels = components(edges)
        collected(spark)
    pairs = written(narrowed(candidate_pairs(shared, active, labels, num, den), reps, num, den), "pairs")
    collected(spark)
    edges = edges.union(written(verified(pairs, active, k, num, den), "links"))
    labels = components(edges)
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "key")
    members = out.groupBy("key").agg(F.count("*").alias("n")).join(reps.select("key", "rep"), "key").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    members = members.select("key", "n", F.coalesce("component", "rep").alias("component"))
    out = spread_join(out.where("key is not null"), members, ["key"], sets.count(), how="left").drop("n").unionByName(out.where("key is null").withColumn("component", F.lit(None).cast("bigint")))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group stays, that of the smallest id; ``docs`` keeps its columns. Rows with a null id can't be named and stay; repeated rows of the id that stays all do."""
    gone = fresh(docs, "gone")
    found = jaccard_components(docs, id_col=id_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs[f"`{id_col}`"].cast("bigint") == found[gone], "left_anti")

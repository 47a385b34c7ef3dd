"""Source divergence audit: how far the sources of a language differ in their words, by sorted runs.

Occurrences are sorted by (term, language, source, document), and a scan of run lengths gives each document's count of a term, then each source's
documents and occurrences. That happens in every task over batches of whole documents, so what is shuffled is a row per term and source of a
task. ``repartition`` by (lang, term) and a secondary sort by (lang, term, source) bring a term's rows together; one scan of the runs adds
them up and keeps the terms of enough documents, a second one, when the totals of each source are known, emits partial sums for pairs of sources
and the terms that stand out. A run needs memory for a row per source of one term, a task for the runs of one chunk.

With p = 1 + floor(10^9 (count + 2) / (N + 2 V)), two shares differ by f(p, q) = floor((p - q)^2 / (p + q)). Terms that neither source has, and
terms that only one has, need no run: their part of a pair's sum follows from how many terms a source has how often, so a run of k sources emits
its own k (k - 1) / 2 pairs only. All arithmetic is in exact integers, for totals of up to 9 * 10^15 words.

Null languages, sources and texts count as empty strings. Every row is a document of its own, repeated rows and rows without an id included; other
columns are not read. A language without kept terms gives pairs of value 0 and no terms; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.llm.common import mapped, written

LEAST_DOCS, TOP = 10, 10
SCALE_STEPS, STEP = 3, 1000  # 10^9, a thousand at a time
#: A task adds up what it has when it holds so many rows, and hands them on if half of them are left.
PENDING_ROWS = 1 << 20
#: Rows of runs that are scanned together.
CHUNK_ROWS = 1 << 17
#: Tables of sources up to this many rows are broadcast (some 10 MB); longer ones are joined by language and SALT.
BROADCAST_GROUPS, SALT = 100_000, 64
PARTIAL = "lang string, term string, source string, docs bigint, n bigint"
_KEYS = ("lang", "term", "source")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of terms: ASCII letters, and all bytes of characters beyond ASCII.
_TERM = np.zeros(256, dtype=bool)
_TERM[97:123] = True
_TERM[128:] = True


def _bytes(column: pa.Array) -> pa.BinaryArray:
    return pc.fill_null(column, "").cast(pa.binary())


def _terms(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All terms of the texts in order, and the index of the text of each."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.binary()), np.zeros(0, dtype=np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    edge[offsets[:-1] - offsets[0]] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    return terms, np.searchsorted(offsets[1:] - offsets[0], starts, side="right")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that agree in all columns begins."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _documents(batch: pa.RecordBatch) -> pa.Table:
    """Partial rows of a batch of documents; a row with an empty term counts a source's documents."""
    langs, sources = (_bytes(batch.column(i)).dictionary_encode() for i in (0, 1))
    terms, doc = _terms(_bytes(batch.column(2)))
    terms = terms.dictionary_encode()
    width = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    group = group[order]
    keys = np.sort(terms.indices.to_numpy().astype(np.int64) * len(order) + place[doc])  # by term, language, source, document
    at = _runs(keys)
    counts = np.diff(np.append(at, len(keys)))
    code, own = keys[at] // max(1, len(order)), group[keys[at] % max(1, len(order))]
    first = _runs(code, own)
    docs = np.diff(np.append(first, len(code)))
    n = np.add.reduceat(counts, first) if len(first) else counts
    marks = _runs(group)
    code, own = code[first], np.concatenate([own[first], group[marks]])
    names = pa.concat_arrays([terms.dictionary.take(pa.array(code)), pa.array([b""] * len(marks), pa.binary())])
    sizes = np.diff(np.append(marks, len(group)))
    rows = [langs.dictionary.take(pa.array(own // width)), names, sources.dictionary.take(pa.array(own % width))]
    return pa.table([*rows, pa.array(np.concatenate([docs, sizes])), pa.array(np.concatenate([n, np.zeros(len(marks), dtype=np.int64)]))], names=[*_KEYS, "docs", "n"])


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(list(_KEYS)).aggregate([("docs", "sum"), ("n", "sum")]).select([*_KEYS, "docs_sum", "n_sum"]).rename_columns([*_KEYS, "docs", "n"])


def _text_batches(table: pa.Table, names: tuple[str, ...] = _KEYS) -> Iterator[pa.RecordBatch]:
    """``table`` in batches, its binary columns as strings."""
    for name in names:
        table = table.set_column(table.schema.get_field_index(name), name, table[name].cast(pa.string()))
    yield from table.combine_chunks().to_batches(max_chunksize=1 << 16)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) as partial rows, added up within the task."""
    pending: list[pa.Table] = []
    held = 0
    for batch in batches:
        if batch.num_rows:
            pending.append(_documents(batch))
            held += pending[-1].num_rows
        if held >= PENDING_ROWS:
            pending = [_added(pending)]
            held = pending[0].num_rows
            if held >= PENDING_ROWS // 2:
                yield from _text_batches(pending.pop())
                held = 0
    if pending:
        yield from _text_batches(_added(pending))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted rows as tables of about ``rows`` rows that hold whole runs of (lang, term); a longer run is added up as it comes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = _last_run(table)
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches() if last < table.num_rows else []
        size = table.num_rows - last
        if size > rows // 2 and "docs" in table.schema.names:  # one run, whose sources come again and again
            held = _merged(table.slice(last)).to_batches()
            size = 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table


def _starts(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        changed = [pc.not_equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)) for c in names]
        new[1:] = np.logical_or.reduce([c.to_numpy() if isinstance(c, pa.Array) else c.combine_chunks().to_numpy(zero_copy_only=False) for c in changed])
    return np.flatnonzero(new)


def _last_run(table: pa.Table) -> int:
    return int(_starts(table, ("lang", "term"))[-1])


def _merged(table: pa.Table) -> pa.Table:
    """Rows of one (lang, term, source) added up; the rows are sorted."""
    at = _starts(table, _KEYS)
    sums = {c: np.add.reduceat(table[c].to_numpy(), at) for c in ("docs", "n")}
    out = table.take(pa.array(at))
    for c, v in sums.items():
        out = out.set_column(out.schema.get_field_index(c), c, pa.array(v))
    return out.combine_chunks()


def _kept(least_docs: int):
    """The first scan: a term's rows, one per source, if enough documents have it; rows with an empty term stay. ``first`` marks one row of each term."""

    def run(batches):
        for table in _chunks(batches, CHUNK_ROWS):
            table = _merged(table)
            at = _starts(table, ("lang", "term"))
            lengths = np.diff(np.append(at, table.num_rows))
            mark = pc.equal(table["term"], "").combine_chunks().to_numpy(zero_copy_only=False)
            keep = np.repeat(np.add.reduceat(table["docs"].to_numpy(), at) >= least_docs, lengths) | mark
            first = np.zeros(table.num_rows, dtype=np.int64)
            first[at] = 1
            first[mark] = 0
            out = table.append_column("first", pa.array(first)).select(["lang", "term", "source", "n", "first"]).filter(pa.array(keep))
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    return run


def share(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)) in 64-bit integers, which a product with 10^9 would overflow."""
    rest, whole = count + 2, total + 2 * terms
    out = np.zeros_like(rest)
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        out, rest = out * STEP + rest // whole, rest % whole
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second scan: rows (kind, lang, source, item, value) of partial pairs, source before item, and of terms that a source has more of than its language."""
    for table in _chunks(batches, CHUNK_ROWS):
        at = _starts(table, ("lang", "term"))
        lengths = np.diff(np.append(at, table.num_rows))
        n, total, terms, whole, base = (table[c].to_numpy() for c in ("n", "total", "terms", "lang_total", "base"))
        p = share(n, total, terms)
        q = share(np.repeat(np.add.reduceat(n, at), lengths), whole, terms)
        value = gap(p, q)
        lang, source = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        width = len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
        above = np.flatnonzero((p > q) & (n > 0))
        # a chunk's own highest terms of each source; rows of one language are in the order of terms, so a stable sort settles ties
        order = above[np.lexsort((-value[above], group[above]))]
        place = np.arange(len(order)) - np.repeat(begun := _runs(group[order]), np.diff(np.append(begun, len(order))))
        best = order[place < TOP]
        yield _emitted("term", lang.dictionary.take(pa.array(group[best] // width)), source.dictionary.take(pa.array(group[best] % width)), table["term"].combine_chunks().take(pa.array(best)), value[best])
        run = np.repeat(np.arange(len(at)), lengths)
        keys, values, ready = [], [], 0
        for step in range(1, int(lengths.max(initial=1))):
            left = np.flatnonzero(run[step:] == run[:-step])
            right = left + step
            a, b, a0, b0 = p[left], p[right], base[left], base[right]
            keys.append(group[left] * width + group[right] % width)
            values.append(gap(a, b) - gap(a, b0) - gap(a0, b) + gap(a0, b0))
            ready += len(left)
            if ready >= PENDING_ROWS:
                yield _pairs(keys, values, lang.dictionary, source.dictionary)
                keys, values, ready = [], [], 0
        if ready:
            yield _pairs(keys, values, lang.dictionary, source.dictionary)


def _pairs(keys: list[np.ndarray], values: list[np.ndarray], langs: pa.Array, sources: pa.Array) -> pa.RecordBatch:
    key, value, width = np.concatenate(keys), np.concatenate(values), len(sources)
    order = np.argsort(key, kind="stable")
    at = _runs(key := key[order])
    key = key[at]
    take = lambda names, i: names.take(pa.array(i))
    return _emitted("pair", take(langs, key // width // width), take(sources, key // width % width), take(sources, key % width), np.add.reduceat(value[order], at))


def _emitted(kind: str, lang: pa.Array, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(value), pa.string()), lang, source, item, pa.array(value)], names=["kind", "lang", "source", "item", "value"])


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``share`` as a column; null without terms."""
    rest, whole, out = count + 2, total + 2 * terms, F.lit(0).cast("bigint")
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        out, rest = out * STEP + F.floor(_div(rest, whole)), rest % whole
    return F.when(terms > 0, out + 1)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two non-negative integers, without doubles."""
    return F.call_function("div", a, b)


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _others(groups: DataFrame, few: bool):
    """A function that joins rows (lang, ...) with every source of their language, as item and item_base."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    if few:
        return lambda rows: rows.join(F.broadcast(other), "lang")
    dealt = other.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALT)).cast("int"))
    return lambda rows: rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).join(dealt, ["lang", "salt"]).drop("salt")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from every other (part pair), and its ``top`` terms above the language's share (part term)."""
    if top > TOP:
        raise ValueError(f"at most {TOP} terms of a source")
    texts = docs.select(*(F.col(f"`{c}`").cast("string") for c in (lang_col, source_col, text_col)))
    partial = mapped(texts, _counted, PARTIAL).repartition("lang", "term").sortWithinPartitions(*_KEYS)
    kept = written(mapped(partial, _kept(least_docs), "lang string, term string, source string, n bigint, first bigint"), "terms", "zstd")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    langs = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("first").alias("terms"))
    sized = own.drop("first").join(langs, "lang")
    groups = written(sized.withColumn("base", _share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))), "sources")
    few = groups.count() <= BROADCAST_GROUPS
    side, others = F.broadcast(groups) if few else groups, _others(groups, few)

    rows = kept.where("term <> ''").drop("first").join(side, ["lang", "source"])
    runs = rows.select("lang", "term", "source", "n", "total", "terms", "lang_total", "base").repartition("lang", "term").sortWithinPartitions(*_KEYS)
    found = written(mapped(runs, _compared, "kind string, lang string, source string, item string, value bigint"), "compared")

    base, other = F.col("base"), F.col("item_base")
    # pairs as if every term were in neither source, then what a source's own terms change against the other's share of a missing one
    none = others(groups).where("source < item").select("lang", "source", "item", F.coalesce(F.col("terms") * _gap(base, other), F.lit(0)).alias("value"))
    often = kept.where("term <> ''").groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(side, ["lang", "source"])
    often = others(often.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))).where("source <> item")
    one = often.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), (F.col("m") * (_gap(F.col("p"), other) - _gap(base, other))).alias("value"))
    both = found.where("kind = 'pair'").drop("kind")
    pairs = none.union(one).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = pairs.select("lang", ends, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = found.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same in DuckDB's SQL, with every term of every source written out.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
x AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // CAST(s.n + 2 * v.v AS HUGEINT) AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // CAST(v.whole + 2 * v.v AS HUGEINT) AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM x WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""

"""Call graphs from types: coarse edges by method sets, refined ones by the types that reach a receiver along assignments.

Functions are named ``type.method``. Method sets against interfaces is a division, by counting. Types are numbered in order of their names, and a number
holds the 64 of one block as its bits: near the ends of long flows a variable has most types.

The types of variables are a fixed point. No block of types asks for another, so each task gets some of them and all assignments, as numbers, and follows
them to the end by itself. Assignments that a task can't hold (``HELD``) are followed in rounds instead: each joins what the last one found, and is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.operators.order import numbered
from lintmill.sources.store import forget, written

_BLOCK = 6  # types of a block, as a power of two: the bits of a bigint
_PART = 3  # blocks of a part, which a row holds, as a power of two
#: Assignments and variables that a task may hold, some 12 bytes each.
HELD = 1 << 25
#: Rows that a task hands on at once, and bytes of listed names.
_ROWS, _BYTES = 1 << 16, 1 << 25
_DEALT = {"kind": "int", "a": "int", "b": "int", "data": "binary", "interface": "string", "type": "string"}
_VARIABLES, _ASSIGNMENTS, _ALLOCATIONS, _ASKED = range(4)


def _function(type_: str = "type", method: str = "method") -> Column:
    return F.concat_ws(".", type_, method)


def implementations(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(interface, type): types (type, method) that have every method of an interface (interface, method). An interface without methods has no row and asks for none."""
    needed = interfaces.select("interface", "method").distinct()
    total = needed.groupBy("interface").agg(F.count("*").alias("n"))
    have = needed.join(methods.select("type", "method").distinct(), "method").groupBy("interface", "type").agg(F.count("*").alias("have"))
    return have.join(total, "interface").where("have = n").select("interface", "type")


def coarse_calls(calls: DataFrame, implemented: DataFrame) -> DataFrame:
    """``calls`` (src, receiver, interface, method, ...) with every function dst that the method can be, by the types of its interface."""
    return calls.join(implemented, "interface").withColumn("dst", _function()).drop("type")


def passed(coarse: DataFrame, parameters: DataFrame) -> DataFrame:
    """Assignments (src, dst) of a call's argument to the parameter (function, variable) of each function that it may call."""
    given = coarse.where("argument is not null").select(F.col("argument").alias("src"), F.col("dst").alias("function"))
    return given.distinct().join(parameters, "function").select("src", F.col("variable").alias("dst")).distinct()


def arguments(calls: DataFrame, implemented: DataFrame, parameters: DataFrame) -> DataFrame:
    """``passed`` by ``calls``, whose repeats are dropped before their functions are looked up."""
    given = calls.where("argument is not null").select("argument", "interface", "method").distinct()
    return passed(coarse_calls(given, implemented), parameters)


def _started(allocations: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct allocations (variable, type), types (type, place) from 0 on in the order of their names, and distinct assignments (variable, next)."""
    own = written(allocations.select("variable", "type").distinct(), "allocations")
    names = written(numbered(own.select("type").distinct(), "type").select("type", (F.col("place") - 1).alias("place")), "names")
    steps = assignments.where(F.col("src").isNotNull() & ~F.col("src").eqNullSafe(F.col("dst"))).select(F.col("src").alias("variable"), F.col("dst").alias("next"))
    return own, names, written(steps.distinct(), "assignments")


def _bits(names: DataFrame) -> DataFrame:
    """(type, block, bit): what the bits of a block's word mean."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND((1 << _BLOCK) - 1).cast("int"))
    return names.select("type", F.shiftright("place", _BLOCK).alias("block"), bit.alias("bit"))


def _same(rows: DataFrame, column: str, keys: DataFrame, key: str, *more: str) -> DataFrame:
    """``rows`` with what ``keys`` has more for the value of a column, null included."""
    own = keys.select(F.col(key).alias("__key"), *more)
    return rows.join(own, F.col(column).eqNullSafe(F.col("__key"))).drop("__key")


def _rounds(own: DataFrame, names: DataFrame, steps: DataFrame) -> DataFrame:
    """(variable, block, word) by rounds, each over all tasks."""
    made = _same(own, "type", _bits(names), "type", "block", "bit").groupBy("variable", "block").agg(F.bit_or("bit").alias("word"))
    state = written(made.withColumn("fresh", F.col("word")), "types")
    none = F.lit(0).cast("bigint")
    while not (frontier := state.where("fresh <> 0")).isEmpty():
        found = frontier.join(steps, "variable").groupBy(F.col("next").alias("variable"), "block").agg(F.bit_or("fresh").alias("found"))
        found = found.select(F.col("variable").alias("__variable"), F.col("block").alias("__block"), "found")
        same = F.col("variable").eqNullSafe(F.col("__variable")) & (F.col("block") == F.col("__block"))
        had, more = F.coalesce("word", none), F.coalesce("found", none)
        place = [F.when(F.col("__block").isNull(), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in ("variable", "block")]
        both = state.drop("fresh").join(found, same, "full")
        last, state = state, written(both.select(*place, had.bitwiseOR(more).alias("word"), more.bitwiseAND(F.bitwise_not(had)).alias("fresh")), "types")
        forget(last)
    return state.drop("fresh")


def _chunks(rows: DataFrame, kind: int) -> DataFrame:
    """``rows`` as few, each a batch in Arrow's format with its first number (a), by which batches are put in order again."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), batch.column(0).slice(0, 1).cast(pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["kind", "a", "data"])

    return rows.mapInArrow(run, "kind int, a int, data binary")


def _flow(first: np.ndarray, target: np.ndarray, at: np.ndarray, bits: np.ndarray, word: np.ndarray, more: np.ndarray) -> None:
    """Let ``bits`` that begin ``at`` numbered variables reach all they can, in ``word``; ``more`` is zeros and is left so. Those of variable i go to target[first[i]:first[i + 1]]."""
    np.bitwise_or.at(word, at, bits)
    at = np.unique(at)
    fresh = word[at]
    while len(at):
        count = first[at + 1] - first[at]
        step = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        to = target[step]
        found = np.repeat(fresh, count) & ~word[to]
        new = found != 0
        to, found = to[new], found[new]
        np.bitwise_or.at(more, to, found)
        at = np.unique(to)
        fresh = more[at]
        more[at] = 0
        word[at] |= fresh


def _followed(lists: bool):
    """Over rows of ``_DEALT`` sorted by kind and first number: all sets, if ``lists``, else which of the asked types reach their receivers."""

    def whole(chunks: list, column: int, kind: pa.DataType) -> pa.Array:
        read = [pa.ipc.open_stream(c).read_all().column(column).combine_chunks() for c in chunks]
        return pa.concat_arrays([x for x in read if len(x)]) if read else pa.array([], kind)

    def run(batches):
        chunks, own, asked = ([], []), [], []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            for kind in np.unique(kinds).tolist():
                rows = batch.filter(pa.array(kinds == kind))
                if kind in (_VARIABLES, _ASSIGNMENTS):
                    chunks[kind].extend(x.as_py() for x in rows.column(3))
                else:
                    (own if kind == _ALLOCATIONS else asked).append(rows.select([1, 2, 4, 5]))
        if not own:
            return
        variables = whole(chunks[0], 1, pa.string())
        target = whole(chunks[1], 1, pa.int32()).to_numpy()
        first = np.concatenate([[0], np.cumsum(np.bincount(whole(chunks[1], 0, pa.int32()).to_numpy(), minlength=len(variables)))])
        chunks = None
        made, wanted = pa.Table.from_batches(own), pa.Table.from_batches(asked) if asked else None
        own = asked = None
        at, place = (made.column(i).to_numpy() for i in range(2))
        who, which = (wanted.column(i).to_numpy() for i in range(2)) if wanted is not None else (np.zeros(0, np.int32),) * 2
        word, more = np.zeros(len(variables), np.uint64), np.zeros(len(variables), np.uint64)
        bit = lambda x: np.uint64(1) << (x & ((1 << _BLOCK) - 1)).astype(np.uint64)
        needed = place if lists else place[np.isin(place >> _BLOCK, which >> _BLOCK)]
        for part in np.unique(needed >> (_BLOCK + _PART)).tolist():
            found = []
            for block in range(part << _PART, (part + 1) << _PART):
                here, there = np.flatnonzero(place >> _BLOCK == block), np.flatnonzero(which >> _BLOCK == block)
                if not len(here) or not (lists or len(there)):
                    continue
                word[:] = 0
                _flow(first, target, at[here], bit(place[here]), word, more)
                if lists:
                    reached = np.flatnonzero(word)
                    found.append((block - (part << _PART), reached, word[reached]))
                else:
                    hit = pa.array(there[word[who[there]] & bit(which[there]) != 0])
                    got = wanted.take(hit)
                    yield from pa.table([variables.take(got.column(0).combine_chunks()), got.column(2), got.column(3)], names=["receiver", "interface", "type"]).to_batches(_ROWS)
            if lists:
                every = np.unique(np.concatenate([reached for _, reached, _ in found]))
                words = np.zeros((len(every), 1 << _PART), np.uint64)
                for i, reached, value in found:
                    words[np.searchsorted(every, reached), i] = value
                for lo in range(0, len(every), _ROWS):
                    own_words = words[lo : lo + _ROWS]
                    sets = pa.ListArray.from_arrays(np.arange(len(own_words) + 1, dtype=np.int32) << _PART, own_words.view(np.int64).ravel())
                    yield pa.RecordBatch.from_arrays([variables.take(pa.array(every[lo : lo + _ROWS])), pa.array(np.full(len(own_words), part << _PART, dtype=np.int64)), sets], names=["variable", "block", "words"])

    return run


def _held(own: DataFrame, names: DataFrame, steps: DataFrame, asked: DataFrame | None = None) -> DataFrame | None:
    """(variable, block, words): the words of a part of blocks, from its first block on, for each variable that one of its types reaches; or those of
    ``asked`` (receiver, interface, type) whose type reaches the receiver. None if tasks can't hold the assignments."""
    variables = written(steps.select("variable").union(steps.select("next")).union(own.select("variable")).distinct(), "variables")
    if steps.count() + variables.count() > HELD:
        forget(variables)
        return None
    ids = written(numbered(variables, "variable").select((F.col("place") - 1).cast("int").alias("id"), "variable"), "numbers")
    forget(variables)
    edges = written(_same(_same(steps, "variable", ids, "variable", F.col("id").alias("a")), "next", ids, "variable", F.col("id").alias("b")).select("a", "b"), "edges")
    groups = max(1, min(-(-names.count() >> (_BLOCK + _PART)), 2 * own.sparkSession.sparkContext.defaultParallelism))
    none = {c: F.lit(None).cast(kind) for c, kind in _DEALT.items()}
    form = lambda rows, **has: rows.select("group", *(has.get(c, F.col(c) if c in rows.columns else none[c]).alias(c) for c in none))
    place, part = F.col("place").cast("int"), F.pmod(F.shiftright("place", _BLOCK + _PART), groups).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = form(_chunks(ids.repartitionByRange("id").sortWithinPartitions("id"), _VARIABLES).withColumn("group", each))
    dealt = dealt.unionByName(form(_chunks(edges.repartitionByRange("a").sortWithinPartitions("a"), _ASSIGNMENTS).withColumn("group", each)))
    numbers = lambda rows: _same(_same(rows, "type", names, "type", "place"), "variable", ids, "variable", "id").withColumn("group", part)
    dealt = dealt.unionByName(form(numbers(own), kind=F.lit(_ALLOCATIONS), a=F.col("id"), b=place, type=none["type"]))
    if asked is not None:
        dealt = dealt.unionByName(form(numbers(asked.withColumnRenamed("receiver", "variable")), kind=F.lit(_ASKED), a=F.col("id"), b=place))
    tasks = dealt.repartitionById(groups, "group").drop("group").sortWithinPartitions("kind", "a")
    out = tasks.mapInArrow(_followed(asked is None), "variable string, block bigint, words array<bigint>" if asked is None else "receiver string, interface string, type string")
    out = written(out, "types")
    forget(ids, edges)
    return out


def _parts(allocations: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variable, block, words), as of ``_held``, and (type, place)."""
    own, names, steps = _started(allocations, assignments)
    parts = _held(own, names, steps)
    return _rounds(own, names, steps).select("variable", "block", F.array("word").alias("words")) if parts is None else parts, names


def type_sets(allocations: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variable, block, word): the types that reach each variable, from where values are made (variable, type) along assignments (src, dst), by any way;
    and (type, block, bit), what a word's bits mean. Blocks and bits follow the order of the types' names."""
    parts, names = _parts(allocations, assignments)
    words = parts.select("variable", F.col("block").alias("__first"), F.posexplode("words").alias("__i", "word")).where("word <> 0")
    return words.select("variable", (F.col("__first") + F.col("__i")).alias("block"), "word"), _bits(names)


def variable_types(allocations: DataFrame, assignments: DataFrame) -> DataFrame:
    """(variable, type): the types that reach each variable, as rows."""
    sets, names = type_sets(allocations, assignments)
    return sets.join(names, "block").where(F.col("word").bitwiseAND(F.col("bit")) != 0).select("variable", "type")


def _listed(names: pa.Array):
    """Over rows (variable, block, words) sorted by variable and block: a row (variable, types, names) per variable. ``names`` are those of all types, in order."""
    bits = 1 << _BLOCK

    def told(variable: pa.Scalar, held: list) -> pa.RecordBatch:
        texts = [t for _, t in held if t is not None]
        return pa.RecordBatch.from_arrays([pa.array([variable.as_py()], pa.string()), pa.array([sum(n for n, _ in held)], pa.int64()), pa.array([",".join(texts) if texts else None], pa.string())], names=["variable", "types", "names"])

    def run(batches):
        longest = pc.max(pc.binary_length(names)).as_py() or 0
        last, held = None, []  # of the variable that the next rows may go on with
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                width = len(batch.column(2)[lo])
                hi = min(batch.num_rows, lo + max(1, _BYTES // (max(width, 1) * bits * (longest + 5))))
                part, lo = batch.slice(lo, hi - lo), hi
                words, start = part.column(2), part.column(1).to_numpy()
                sizes = pc.list_value_length(words).to_numpy()
                flat = words.flatten().to_numpy().view(np.uint8).reshape(-1, 8)
                word, bit = np.nonzero(np.unpackbits(flat, axis=1, bitorder="little"))
                row = np.repeat(np.arange(len(part)), sizes)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                label = names.take(pa.array(((start[row] + inner)[word] << _BLOCK) + bit))
                row = row[word]
                runs = pc.run_end_encode(part.column(0))
                ends = runs.run_ends.to_numpy()
                count = np.bincount(np.searchsorted(ends, row, side="right"), minlength=len(ends))
                if label.null_count:
                    valid = label.is_valid().to_numpy(zero_copy_only=False)
                    label, row = label.drop_null(), row[valid]
                named = np.bincount(np.searchsorted(ends, row, side="right"), minlength=len(ends))
                text = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(named)]).astype(np.int32), label), ",")
                text = pc.if_else(pa.array(named > 0), text, pa.scalar(None, pa.string()))
                values = runs.values
                if held and not values[0].equals(last):
                    yield told(last, held)
                    held = []
                begin, end = 1 if held else 0, len(values) - 1
                if held:
                    held.append((int(count[0]), text[0].as_py()))
                    last = values[0]
                    if not end:
                        continue
                    yield told(last, held)
                if end > begin:
                    yield pa.RecordBatch.from_arrays([values.slice(begin, end - begin), pa.array(count[begin:end].astype(np.int64)), text.slice(begin, end - begin)], names=["variable", "types", "names"])
                last, held = values[end], [(int(count[end]), text[end].as_py())]
        if held:
            yield told(last, held)

    return run


def _lists(parts: DataFrame, names: DataFrame, *order: str) -> DataFrame:
    every = names.orderBy(*order).select("type").toArrow()["type"].combine_chunks()  # the names of all types go to every task
    tasks = 4 * parts.sparkSession.sparkContext.defaultParallelism
    return parts.repartition(tasks, "variable").sortWithinPartitions("variable", "block").mapInArrow(_listed(every), "variable string, types bigint, names string")


def type_lists(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(variable, types, names): the number of each variable's types and their names in order, joined by commas; no row per variable and type is made."""
    places = names.withColumn("__bit", F.col("bit") < 0)  # the last bit of a block is the sign
    return _lists(sets.select("variable", "block", F.array("word").alias("words")), places, "block", "__bit", "bit")


def variable_lists(allocations: DataFrame, assignments: DataFrame) -> DataFrame:
    """``type_lists`` of ``type_sets``, without a row per block."""
    return _lists(*_parts(allocations, assignments), "place")


def reached(asked: DataFrame, allocations: DataFrame, assignments: DataFrame) -> DataFrame:
    """Those of ``asked`` (receiver, interface, type), which are distinct, whose type reaches the receiver; only these types are looked for."""
    own, names, steps = _started(allocations, assignments)
    found = _held(own, names, steps, asked)
    if found is None:
        sets = _rounds(own, names, steps).withColumnRenamed("variable", "receiver")
        found = asked.join(_bits(names), "type").join(sets, ["receiver", "block"]).where(F.col("word").bitwiseAND(F.col("bit")) != 0).select("receiver", "interface", "type")
    return found


def built(calls: DataFrame, methods: DataFrame, interfaces: DataFrame, allocations: DataFrame, assignments: DataFrame, parameters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The refined and the coarse call edges of dynamic ``calls`` (src, receiver, interface, method, argument, ...), a row per call and function, for ``graph.call_graph``.

    Values flow along ``assignments`` and into the parameters of all functions that the coarse graph lets a call reach, as the refinement starts from it.
    """
    implemented = written(implementations(methods, interfaces), "implementations")
    calls = written(calls, "calls")
    asked = calls.where("receiver is not null").select("receiver", "interface").distinct().join(implemented, "interface").select("receiver", "interface", "type")
    found = reached(asked, allocations, assignments.select("src", "dst").union(arguments(calls, implemented, parameters)))
    refined = calls.join(found, ["receiver", "interface"]).withColumn("dst", _function()).drop("type")
    return refined, coarse_calls(calls, implemented)

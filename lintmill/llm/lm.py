"""Brown's class-based bigram model: exchange clustering gives every training word its class, and texts get a smoothed log-probability.

    log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class)

The exchange goes from the frequent words to the rare ones, always over all training documents:

1. The ``SEEDS`` most frequent words move one by one, each to the class that raises the likelihood of the class bigrams most, until none moves. Other
   words are one unit meanwhile, in a class of its own.
2. The common words, at most ``COMMON``, all move at once, ``ROUNDS`` times: how often each class stands before and after a word, its profile, is counted by all
   tasks, and the word goes to the class under which these neighbours are most likely. The table of class bigrams is counted anew after each round; a later round that
   does not raise the likelihood is undone and ends the exchange.
3. Every other word then does the same once, by its neighbours among the common words.

The number of classes grows with the vocabulary. The end of a text is a token and a class by itself, and stands before the first word. Words that
training texts lack all belong to the class with the most different words. P(word | class) sums to one over a class's words and one unknown word.

Texts are cut into words twice: for the counts, and to write them as numbers of common words, with the others beside them; all later steps read these numbers.
What reaches the driver or is broadcast is bounded: the common words with their classes and counts, and tables by classes. All other words stay in tables
that are joined, one row per occurrence, so any vocabulary will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import collected, forget, mapped, written

SEEDS, SWEEPS, ROUNDS = 1000, 30, 2
COMMON, COMMON_BYTES = 200_000, 64
#: So many classes for a vocabulary of v words: MIN_CLASSES, or v to this power if that is more.
MIN_CLASSES, CLASS_POWER = 16, 0.3
#: Tokens whose profiles a task counts at once, and rows of profiles that it adds up at once.
CHUNK, PROFILE_ROWS = 4 << 20, 1 << 14
ADD = 0.1
PRIOR = 1000.0
SMOOTH = 0.5


def n_classes(v: int) -> int:
    return max(MIN_CLASSES, round(v**CLASS_POWER))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of the texts in one array, and where each text begins, with the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets, flat = lists.offsets.to_numpy(), lists.values
    kept = pc.greater(pc.binary_length(flat), 0)
    places = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(kept), places[offsets] - places[offsets[0]] if len(offsets) else np.zeros(1, dtype=np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the texts in the first column; the end of a text counts as the empty word."""

    def run(batches):
        for batch in batches:
            counts = pc.value_counts(split(batch.column(0))[0])
            words = pa.concat_arrays([counts.field("values"), pa.array([""])])
            yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([counts.field("counts"), pa.array([batch.num_rows])])], names=["word", "n"])

    return mapped(texts, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def common_words(counts: DataFrame, limit: int = COMMON, max_bytes: int = COMMON_BYTES) -> list[tuple[str, int]]:
    """At most ``limit`` most frequent words of at most ``max_bytes``, most frequent first: all those of a count above a bound. The end is not among them."""
    short = counts.where((F.octet_length("word") <= max_bytes) & (F.col("word") != ""))
    level = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, 0
    for row in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += row["count"]
        if total > limit:
            least = row["level"] + 1
            break
    found = short.where(level >= least).select("word", "n").toArrow().to_pydict()
    return sorted(zip(found["word"], found["n"], strict=True), key=lambda x: (-x[1], x[0]))


def coded(rows: DataFrame, common: list[tuple[str, int]]) -> DataFrame:
    """row, doc_id, held_out, codes (numbers of the common words, 32 bits each, -1 for others) and rare (the others in turn) of (doc_id, held_out, text)."""
    words = rows.sparkSession.sparkContext.broadcast(pa.array([w for w, _ in common], pa.string()))

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            flat, at = split(batch.column(2))
            codes = pc.index_in(flat, words.value).fill_null(-1).to_numpy()
            rare = np.concatenate([[0], np.cumsum(codes < 0)])[at].astype(np.int32)
            columns = [
                pa.array(np.arange(row, row + batch.num_rows)),
                batch.column(0),
                batch.column(1),
                _binaries(codes.astype("<i4"), at),
                pa.ListArray.from_arrays(pa.array(rare), flat.filter(pa.array(codes < 0))),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "codes", "rare"])

    return mapped(rows, run, "row bigint, doc_id bigint, held_out boolean, codes binary, rare array<string>")


def _binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values between neighbouring places, as bytes."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``_binaries`` was made of; places begin at 0."""
    size = np.dtype(kind).itemsize
    if not len(column):
        return np.zeros(0, dtype=kind), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // size
    data = np.frombuffer(column.buffers()[2] or b"", dtype=kind)[at[0] : at[-1]]
    return data, at - at[0]


def _sequences(batches, end: int) -> Iterator[np.ndarray]:
    """The codes of many texts in a row, the end before, between and after them; ``CHUNK`` tokens or one text at least."""
    held, size = [], 0
    for batch in batches:
        data, at = _values(batch.column(0), "<i4")
        if batch.num_rows:  # texts of two batches meet at one end
            held.append(np.insert(data, at if not held else at[1:], end))
            size += len(held[-1])
        if size >= CHUNK:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _counted(codes: DataFrame, shared, size: int, end: int) -> np.ndarray:
    """How often each label follows each other one; shared: the broadcast label of each code, the last one that of code -1."""

    def run(batches):
        total = np.zeros(size * size, dtype=np.int64)
        for seq in _sequences(batches, end):
            label = shared.value[seq]
            own = label[:-1].astype(np.int64) * size + label[1:]
            total += np.bincount(own, minlength=size * size)
        code = np.flatnonzero(total)
        for at in range(0, len(code), 1 << 17):
            part = code[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["code", "n"])

    found = mapped(codes, run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(table: np.ndarray) -> float:
    """What the classes add to the log-likelihood of the words, by the bigrams of classes."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit. The last unit, the end, has class 0 and the one before it, all other words, class ``classes``; the others
    move one by one to the class that raises the likelihood most, until none moves or ``sweeps`` are over."""
    size = len(bigrams)
    order = np.argsort(-bigrams[:-2].sum(1), kind="stable")
    where = np.zeros(size, dtype=np.int64)
    where[order] = 1 + np.arange(size - 2) % max(1, classes - 1)
    where[-2] = classes
    member = np.zeros((size, classes + 1))
    member[np.arange(size), where] = 1.0
    to, back = bigrams @ member, bigrams.T @ member
    table = member.T @ to
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own, out, into = where[w], bigrams[w, w], to[w].copy(), back[w].copy()
            table[a] -= out
            table[:, a] -= into
            table[a, a] += own
            out[a] -= own
            into[a] -= own
            rows, columns, logs = table.sum(1), table.sum(0), _f(table)
            r, c = out.sum() + own, into.sum() + own
            by_row = _f(table + out) - logs
            by_column = _f(table + into[:, None]) - logs
            diagonal = np.diagonal(table)
            gain = by_row.sum(1) - np.diagonal(by_row) + by_column.sum(0) - np.diagonal(by_column) + _f(diagonal + out + into + own) - _f(diagonal)
            gain -= _f(rows + r) - _f(rows) + _f(columns + c) - _f(columns)
            gain[[0, classes]] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += into
            table[b, b] += own
            if b != a:
                moved += 1
                where[w] = b
                to[:, a] -= bigrams[:, w]
                to[:, b] += bigrams[:, w]
                back[:, a] -= bigrams[w]
                back[:, b] += bigrams[w]
        if not moved:
            break
    return where


class Neighbours:
    """How likely each class 1 .. k - 1 makes a neighbour before and after, from the smoothed class bigrams; index k stands for a word without class.

    The classes' shares of the different words are the prior, which decides for words that occur once or twice.
    """

    def __init__(self, table: np.ndarray, kinds: np.ndarray):
        k = len(table) - 1
        self.k, self.prior = k, np.log(kinds + SMOOTH)
        seen = table[:, :k].sum(0) + SMOOTH
        size = np.log(seen)
        rows = table[:k, :k].sum(1, keepdims=True)
        step = np.log((table[:k, :k] + PRIOR * seen / seen.sum()) / (rows + PRIOR))
        before, after = step, step.T
        # an unknown neighbour before a word tells no more than the classes' sizes do
        self.before = np.vstack([before, size])
        self.after = np.vstack([after, np.zeros(k)])
        self.size = size

    def best(self, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The class of each word, from how often each class stands before and after it and how often the word occurs."""
        return self.choice(before @ self.before + after @ self.after - n[:, None] * self.size)

    def choice(self, score: np.ndarray) -> np.ndarray:
        score = score + self.prior
        score[:, 0] = -np.inf
        return score.argmax(1).astype(np.int32)


def profiles(codes: DataFrame, shared, k: int, end: int) -> DataFrame:
    """(word, codes, counts): how often each class stands before (code c) and after (code k + 1 + c) each common word, a chunk of tokens at a time."""
    c = k + 1

    def run(batches):
        for seq in _sequences(batches, end):
            label = shared.value[seq]
            at = np.flatnonzero((seq >= 0) & (seq != end))
            word = seq[at].astype(np.int64) * (2 * c)
            keys = np.concatenate([word + label[at - 1], word + c + label[at + 1]])
            if 2 * c * (end + 1) < 1 << 31:
                keys = keys.astype(np.int32)
            keys, counts = np.unique(keys, return_counts=True)
            words, code = np.divmod(keys, 2 * c)
            first = np.flatnonzero(np.diff(words, prepend=-1))
            for lo in range(0, len(first), 1 << 16):
                own = first[lo : lo + (1 << 16)]
                stop = first[lo + len(own)] if lo + len(own) < len(first) else len(words)
                places = np.append(own, stop) - own[0]
                columns = [pa.array(words[own].astype(np.int32)), _binaries(code[own[0] : stop].astype("<i4"), places), _binaries(counts[own[0] : stop].astype("<i4"), places)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "codes", "counts"])

    return mapped(codes, run, "word int, codes binary, counts binary")


def moved(found: DataFrame, near: Neighbours, end: int) -> np.ndarray:
    """The class of each common word by its profile; what comes to the driver is one row per common word."""
    c = near.k + 1

    def run(batches):
        keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

        def added() -> tuple[np.ndarray, np.ndarray]:
            own, at = np.unique(np.concatenate(keys), return_inverse=True)
            return own, np.bincount(at, weights=np.concatenate(counts), minlength=len(own)).astype(np.int64)

        for batch in batches:
            code, at = _values(batch.column(1), "<i4")
            n, _ = _values(batch.column(2), "<i4")
            keys.append(np.repeat(batch.column(0).to_numpy().astype(np.int64) * (2 * c), np.diff(at)) + code)
            counts.append(n.astype(np.int64))
            if sum(map(len, keys)) > 2 * len(keys[0]) + CHUNK:
                one, total = added()
                keys, counts = [one], [total]
        own, total = added()
        words, code = np.divmod(own, 2 * c)
        starts = np.append(np.flatnonzero(np.diff(words, prepend=-1)), len(words))
        for lo in range(0, len(starts) - 1, 2048):
            part = starts[lo : lo + 2049]
            dense = np.zeros((len(part) - 1, 2 * c))
            span = slice(part[0], part[-1])
            dense[np.repeat(np.arange(len(part) - 1), np.diff(part)), code[span]] = total[span]
            best = near.best(dense[:, :c], dense[:, c:], dense[:, :c].sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(words[part[:-1]].astype(np.int32)), pa.array(best)], names=["word", "class"])

    rows = mapped(found.repartition("word"), run, "word int, class int").toArrow()
    out = np.full(end, near.k, dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["class"].to_numpy()
    return out


def rare_words(train: DataFrame, shared, near: Neighbours, end: int) -> DataFrame:
    """(word, n, class) of the training words that aren't common: each goes to the class that its neighbours make most likely."""
    c = near.k + 1

    def contexts(batches):
        for batch in batches:
            data, at = _values(batch.column(0), "<i4")
            if not batch.num_rows:
                continue
            seq = np.insert(data, at, end)
            label, place = shared.value[seq], np.flatnonzero(seq < 0)
            yield pa.RecordBatch.from_arrays([batch.column(1).flatten(), pa.array((label[place - 1] * c + label[place + 1]).astype(np.int32))], names=["word", "code"])

    def run(batches):
        word, total, n = None, np.zeros(near.k), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, PROFILE_ROWS):
                part = batch.slice(lo, PROFILE_ROWS)
                words, code = part.column(0), part.column(1).to_numpy()
                new = np.concatenate([[True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)])
                first = np.flatnonzero(new)
                sums = np.add.reduceat(near.before[code // c] + near.after[code % c], first, axis=0)
                sizes = np.diff(np.append(first, len(code)))
                names = words.take(pa.array(first))
                if word is not None and names[0].as_py() == word:
                    sums[0] += total
                    sizes[0] += n
                elif word is not None:
                    names = pa.concat_arrays([pa.array([word], pa.string()), names])
                    sums, sizes = np.vstack([total, sums]), np.concatenate([[n], sizes])
                word, total, n = names[len(names) - 1].as_py(), sums[-1], int(sizes[-1])
                best = near.choice(sums[:-1] - sizes[:-1, None] * near.size)
                yield pa.RecordBatch.from_arrays([names.slice(0, len(names) - 1), pa.array(sizes[:-1].astype(np.int64)), pa.array(best)], names=["word", "n", "class"])
        if word is not None:
            best = near.choice((total - n * near.size)[None, :])
            yield pa.RecordBatch.from_arrays([pa.array([word], pa.string()), pa.array([n], pa.int64()), pa.array(best)], names=["word", "n", "class"])

    rows = mapped(train.where(F.size("rare") > 0).select("codes", "rare"), contexts, "word string, code int")
    return mapped(rows.repartition("word").sortWithinPartitions("word", "code"), run, "word string, n bigint, class int")


def clustered(train: DataFrame, common: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each common word, of the end (0) and of all other words (k), and the table of class bigrams; train: coded texts."""
    codes, context = train.select("codes"), train.sparkSession.sparkContext
    end, seeds = len(common), min(SEEDS, len(common))
    units = np.full(end + 2, seeds, dtype=np.int32)
    units[:seeds] = np.arange(seeds)
    units[end] = seeds + 1
    shared = context.broadcast(units)
    bigrams = _counted(codes, shared, seeds + 2, end)
    shared.unpersist()
    where = exchange(bigrams, k)
    classes = np.full(end + 2, k, dtype=np.int32)
    classes[:seeds], classes[end] = where[:seeds], 0
    member = np.zeros((seeds + 2, k + 1))
    member[np.arange(seeds + 2), where] = 1.0
    table = member.T @ bigrams @ member
    for _ in range(ROUNDS if end else 0):
        shared = context.broadcast(classes)
        new = classes.copy()
        new[:end] = moved(profiles(codes, shared, k, end), Neighbours(table, np.bincount(classes, minlength=k)[:k]), end)
        shared.unpersist()
        if (new == classes).all():
            break
        shared = context.broadcast(new)
        after = _counted(codes, shared, k + 1, end)
        shared.unpersist()
        collected(train.sparkSession)
        if (classes[:end] < k).all() and likelihood(after) <= likelihood(table):
            break
        classes, table = new, after
    return classes, table


class Model:
    """What scoring needs: class transitions, and the words' counts in their classes."""

    def __init__(self, classes: np.ndarray, common: list[tuple[str, int]], k: int, kinds: np.ndarray, ends: int, n: int, v: int):
        self.classes, self.k, self.kinds, self.n, self.v = classes, k, kinds, n, v
        self.unknown = int(kinds[1:].argmax()) + 1
        self.log_count = np.log10(np.array([*(x for _, x in common), 0, 0], dtype=np.float64) + ADD)
        self.base_mass = float(np.log10(n + ADD * (v + 1)))
        self.end_log, self.end_known = float(np.log10(ends + ADD)), int(ends > 0)

    def set_table(self, table: np.ndarray) -> Model:
        """table: how often each class follows each other one, all training words having their classes."""
        k, seen = self.k, table.sum(0)
        share = (seen + 1) / (seen.sum() + k)
        self.step = np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))
        self.mass = np.log10(seen + ADD * (self.kinds + 1))
        return self


CLASSED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, classes binary"


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of the values between neighbouring places, none being 0."""
    out, some = np.zeros(len(at) - 1), np.diff(at) > 0
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some])
    return out


def classed(texts: DataFrame, lexicon: DataFrame, shared) -> DataFrame:
    """``CLASSED`` of coded texts: their base score, what the words' counts give, and the classes of their words."""
    places = texts.where(F.size("rare") > 0).select("row", F.posexplode("rare").alias("pos", "word"))
    found = places.join(lexicon, "word", "left").select("row", F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(-1)).alias("class")).alias("x"))
    found = found.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("found"))
    rows = texts.drop("rare").join(found, "row", "left").select("doc_id", "held_out", "codes", F.col("found.n").alias("n"), F.col("found.class").alias("class"))

    def run(batches):
        model = shared.value
        for batch in batches:
            codes, at = _values(batch.column(2), "<i4")
            rare = codes < 0
            logs, classes, known = model.log_count[codes], model.classes[codes].astype(np.int64), ~rare
            n = batch.column(3).flatten().to_numpy().astype(np.float64)
            logs[rare], known[rare] = np.log10(n + ADD), n > 0
            own = batch.column(4).flatten().to_numpy()
            classes[rare] = np.where(own < 0, model.unknown, own)
            emission, tokens = _sums(logs, at) + model.end_log, np.diff(at) + 1
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(tokens),
                pa.array(_sums(known.astype(np.int64), at).astype(np.int64) + model.end_known),
                pa.array(emission - tokens * model.base_mass),
                pa.array(emission),
                _binaries(classes.astype("<u2"), at),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in CLASSED.split(", ")])

    return mapped(rows, run, CLASSED)


def _table(train: DataFrame, k: int) -> np.ndarray:
    """How often each class follows each other one in classed texts."""

    def run(batches):
        total = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            data, at = _values(batch.column(0), "<u2")
            if batch.num_rows:
                seq = np.insert(data, at, 0).astype(np.int64)
                total += np.bincount(seq[:-1] * k + seq[1:], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["code", "n"])

    out = np.zeros(k * k)
    for code, n in mapped(train.select("classes"), run, "code bigint, n bigint").groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out.reshape(k, k)


def _scored(rows: DataFrame, shared) -> DataFrame:
    def run(batches):
        model = shared.value
        for batch in batches:
            data, at = _values(batch.column(6), "<u2")
            seq = np.insert(data, at, 0)
            steps = model.step[seq[:-1], seq[1:]] - model.mass[seq[1:]]
            score = batch.column(5).to_numpy() + _sums(steps, at + np.arange(len(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return mapped(rows, run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def trained(rows: DataFrame) -> tuple[DataFrame, DataFrame, Model, list[tuple[str, int]]]:
    """Coded texts, the lexicon (word, n, class) of words that aren't common, the model without its table, and the common words, of (doc_id, held_out, text)."""
    spark = rows.sparkSession
    counts = written(word_counts(rows.where("not held_out").select("text")), "word-counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    common = common_words(counts)
    forget(counts)
    collected(spark)
    texts = written(coded(rows, common), "coded", "zstd")
    train, k, end = texts.where("not held_out"), n_classes(v), len(common)
    classes, table = clustered(train, common, k)
    shared = spark.sparkContext.broadcast(classes)
    kinds = np.bincount(classes[: end + 1], minlength=k + 1)[:k].astype(np.float64)
    lexicon = written(rare_words(train, shared, Neighbours(table, kinds), end), "lexicon")
    collected(spark)
    for row in lexicon.groupBy("class").count().collect():
        kinds[row["class"]] += row["count"]
    if not ends:
        kinds[0] = 0
    return texts, lexicon, Model(classes, common, k, kinds, ends, n, v), common


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each document.

    Documents whose crc32 of the id as text is divisible by 10 are held out, the others train. A null text is empty: its only token is the end.
    A null id has an empty text. Repeated rows train and are scored each by themselves. An empty table gives no rows; with no
    training documents every token is unknown. Of classes that are equally good for a word the first is taken. Other columns are not read.
    """
    ids = F.col(f"`{id_col}`")
    held = (F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out")
    rows = docs.select(ids.cast("bigint").alias("doc_id"), held, F.col(f"`{text_col}`").cast("string").alias("text"))
    texts, lexicon, model, _ = trained(rows)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    done = written(classed(texts, lexicon, shared), "classed", "zstd")
    forget(texts, lexicon)
    shared.unpersist()
    collected(spark)
    out = _scored(done, spark.sparkContext.broadcast(model.set_table(_table(done.where("not held_out"), model.k))))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score", perplexity)

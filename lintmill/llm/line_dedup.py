"""Line deduplication by winnowing over line hashes, in DataFrame functions alone.

A window is the fewest consecutive lines that have ``RUN_WORDS`` = 50 words together, from a given line on or up to a given line; lines
without a word don't count. The line of a window's least hash, the first of them, is its fingerprint. Two runs of RUN_WORDS words or more
that agree have equal windows and so the same fingerprints: no common run is without one.

Positions are joined by fingerprint first: one that stands at a single place of all documents ends there, with its windows. Every other
place is then extended to both sides of the fingerprint, window by window, and each window is judged against the first occurrence of that same
window in the order of document and line. The windows of neighbouring fingerprints overlap, so together they give a match in its whole
length. No pair of documents is compared, so a run is found wherever its parts occurred first, and a passage that n documents have costs n rows.

A line or window that a third of all documents have is aggregated before the shuffle, and the join back broadcasts what is so frequent.
Hashes of 96 bits stand for windows; the texts themselves move once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import SPACE, collected, forget, fresh, let, spread_join, written
from lintmill.llm.quality import split_words

RUN_WORDS = 50
_LAST = 2**63 - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The key of a document: its id, null ids last, and the hash of its text."""
    return F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LAST)), F.xxhash64(F.col(f"`{text_col}`"))


def windows(h: Column, w: Column) -> Column:
    """(f, p, g, c, s, e) of the least windows: fingerprint and its line, hashes, lines with the end exclusive; h: line hashes, w: the lines' words, one each at least."""
    # The sum of at most 2 * RUN_WORDS - 1 words is in the low 7 bits, the number of lines above them.
    fold = lambda part: F.aggregate(part, F.lit(0), lambda a, n: F.when(a.bitwiseAND(127) < RUN_WORDS, a + n + 128).otherwise(a))
    lines = lambda a, other: F.when(a.bitwiseAND(127) >= RUN_WORDS, F.shiftright(a, 7)).otherwise(other)

    def needed(n: Column, i: Column) -> Column:
        """The number of lines from i on; null if there are too few words. Most windows are of a few lines, which are tried first."""
        whole = let(fold(F.slice(n, i + 1, RUN_WORDS)), lambda a: lines(a, F.lit(None).cast("int")))
        return F.when(F.get(n, i) >= RUN_WORDS, 1).otherwise(let(fold(F.slice(n, i + 1, 8)), lambda a: lines(a, whole)))

    # A window is its first line times 64 plus its number of lines, which is 50 at most.
    code = lambda start, size: start.cast("bigint") * 64 + size
    each = lambda n, at: F.transform(F.sequence(F.lit(0), F.size(n) - 1), lambda i: let(needed(n, i), lambda k: code(at(i, k), k)))

    def both(n: Column) -> Column:
        return F.concat(each(n, lambda i, k: i), let(F.reverse(n), lambda r: each(r, lambda i, k: F.size(n) - i - k)))

    def hashed(x: Column) -> Column:
        start, size = F.shiftright(x, 6).cast("int"), x.bitwiseAND(63).cast("int")

        def window(part: Column) -> Column:
            least = F.array_min(part)
            at = start + F.array_position(part, least).cast("int") - 1
            return F.struct(least.alias("f"), at.alias("p"), F.xxhash64(part).alias("g"), F.hash(part).alias("c"), start.alias("s"), (start + size).alias("e"))

        return let(F.slice(h, start + 1, size), window)

    capped = F.transform(w, lambda n: F.least(n, F.lit(RUN_WORDS)))
    return F.transform(F.filter(F.array_distinct(let(capped, both)), lambda x: x.isNotNull()), hashed)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per window of each document: o, t, f, p, g, c, s, e; lines are counted among those with words."""
    text, (o, t) = F.col(f"`{text_col}`"), _keys(id_col, text_col)
    worded = F.filter(_lines(text), lambda x: x.rlike(f"[^{SPACE}]"))
    both = F.transform(worded, lambda x: F.struct(F.xxhash64(F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")).alias("h"), F.size(split_words(x)).alias("w")))
    rows = docs.where(text.isNotNull()).select(o.alias("o"), t.alias("t"), both.alias("b")).select("o", "t", F.col("b.h").alias("h"), F.col("b.w").alias("w"))
    rows = rows.where(F.aggregate("w", F.lit(0), lambda a, n: a + n) >= RUN_WORDS)
    found = let(F.col("w"), lambda w: let(F.col("h"), lambda h: windows(h, w)))
    return rows.select("o", "t", F.explode(found).alias("x")).select("o", "t", "x.*")


def repeated_places(places: DataFrame) -> DataFrame:
    """The windows whose fingerprint stands at more than one place."""
    place = F.xxhash64("o", "t", "p")
    joined = places.groupBy("f").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("f", "n")
    return spread_join(places, joined, ["f"], places.count()).drop("n")


def repeated_runs(places: DataFrame) -> DataFrame:
    """(o, t, runs): the lines of each document, counting those with words, that an earlier run already has; ``places`` are written ones."""
    first = places.groupBy("g", "c").agg(F.min(F.struct("o", "t", "s")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = spread_join(places, first, ["g", "c"], places.count()).where(F.struct("o", "t", "s") > F.col("first"))
    sorted_runs = later.groupBy("o", "t").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))

    def apart(runs: Column) -> Column:
        """The same lines in ranges that don't overlap; in this order the ends never fall."""
        cut = F.transform(runs, lambda r, i: F.struct(F.greatest(r["s"], F.get(runs, i - 1)["e"]).alias("s"), r["e"].alias("e")))
        return F.filter(cut, lambda r: r["s"] < r["e"])

    return sorted_runs.select("o", "t", let(F.col("r"), apart).alias("runs"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with __clean (the text without repeated runs), __n_lines, __deleted_lines and __deleted_words.

    The first occurrence, by id and then line, stays; rows with a null id come last, and rows of one id by the hash of their text. Rows that
    agree in id and text are one document and are treated alike. A null text stays null with no lines. A text of which all lines go becomes
    empty. Texts without a repeated run stay as they are, to the byte; an empty table gives no rows. All columns of ``docs`` pass through;
    if one has a name that is added here, the added one gets underscores before it, so they are best found as the last four columns.
    """
    every = written(sketches(docs, id_col, text_col), "line-windows")
    collected(docs.sparkSession)
    places = written(repeated_places(every), "line-places")
    forget(every)
    collected(docs.sparkSession)
    own, runs_name, x = (fresh(docs, name) for name in ("__key", "__runs", "__x"))
    o, t = _keys(id_col, text_col)
    runs = repeated_runs(places).select(F.struct("o", "t").alias(own), F.col("runs").alias(runs_name))
    joined = docs.withColumn(own, F.struct(o.alias("o"), t.alias("t"))).join(runs, own, "left")

    def places(lines: Column) -> Column:
        """The numbers of the deleted lines among all lines."""
        worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(f"[^{SPACE}]"), i)), lambda i: i.isNotNull())
        counted = F.flatten(F.transform(runs_name, lambda r: F.sequence(r["s"], r["e"] - 1)))
        return let(worded, lambda at: F.transform(counted, lambda k: F.get(at, k)))

    def taken(lines: Column) -> Column:
        def parts(gone: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            words = F.aggregate(gone, F.lit(0).cast("bigint"), lambda a, i: a + F.size(split_words(F.get(lines, i))))
            clean = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
            return F.struct(clean.alias("clean"), F.size(gone).cast("bigint").alias("lines"), words.alias("words"))

        return let(places(lines), parts)

    text = F.col(f"`{text_col}`")
    none = F.struct(text.alias("clean"), F.lit(0).cast("bigint").alias("lines"), F.lit(0).cast("bigint").alias("words"))
    joined = joined.withColumn(x, F.when(F.col(runs_name).isNull(), none).otherwise(let(_lines(text), taken)))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("bigint")
    out = {"__clean": F.col(x)["clean"], "__n_lines": n_lines, "__deleted_lines": F.col(x)["lines"], "__deleted_words": F.col(x)["words"]}
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), *(v.alias(fresh(docs, k)) for k, v in out.items()))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated runs; n_chars follows the text. Other columns stay, whatever their names."""
    found = deduplicated(docs)
    clean, _, lines, _ = found.columns[-4:]
    new = {"text": F.col(clean), "n_chars": F.length(clean).cast("bigint")}
    changed = F.col(lines) > 0
    return found.select(*(F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))

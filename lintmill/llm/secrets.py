"""Secret scanning, in DataFrame functions alone: fixed patterns, and Markov models of characters for what they miss.

Two first-order models over the characters of keys are trained from labelled samples, one of random strings and one of ordinary words
and identifiers. In each run of such characters every stretch counts whose transitions have a log-likelihood ratio that is high enough
in all, so words joined to a secret don't hide it. Only counts of character pairs, bounded by the square of the alphabet, come to the driver.

Places come from ``split`` and ``regexp_extract_all`` with one pattern: the lengths of the pieces and of the matches, added up in turn. A
text is taken apart only if the pattern occurs in it, so most texts cost one search per pattern. Nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm.common import fresh, let
from lintmill.llm.quality import split_words

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."
#: Of the default sample: random strings, and documents with the smallest ids.
SAMPLE_STRINGS, SAMPLE_DOCS = 2000, 16
#: A stretch's least length, and its least log-likelihood ratio in all (natural logarithm), that of 20 characters with 0.7 per transition.
MIN_RUN, MIN_TOTAL = 12, 13.3
RUN = f"[A-Za-z0-9+/_-]{{{MIN_RUN},}}"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: kind, pattern, group whose length counts, least length. Fixed values.
BASE = (
    ("assign", f"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
)
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _spans(text: Column, rank: int, kind: str, pattern: str, keep=None, inside=None) -> Column:
    """The places of the leftmost non-overlapping matches that ``keep`` accepts, or of what ``inside`` gives of them, in code points, end exclusive."""
    begin = F.expr(f"cast(struct(0, array()) as struct<at:int,out:{SPAN}>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        span = lambda s, e: F.struct(s.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"))
        if inside:
            out = F.concat(acc["out"], F.transform(inside(x["match"]), lambda p: span(start + p["s"], start + p["e"])))
        else:
            out = F.when(keep(x["match"]), F.concat(acc["out"], F.array(span(start, end)))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out")).cast(f"struct<at:int,out:{SPAN}>")

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("match")))
    found = F.aggregate(F.filter(pairs, lambda x: x["match"].isNotNull()), begin, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(_none())


def _base(text: Column) -> Column:
    def accepts(pattern: str, group: int, least: int):
        return lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least

    each = [_spans(text, rank, kind, pattern, accepts(pattern, group, least)) for rank, (kind, pattern, group, least) in enumerate(BASE)]
    return F.sort_array(F.concat(*each))


def sample(spark: SparkSession, docs: DataFrame, n_strings: int = SAMPLE_STRINGS, n_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled strings (text, secret): ``n_strings`` random ones, and the words of ``n_docs`` documents, alone and joined to identifiers.

    What the fixed patterns match is taken out of the documents first, so that their secrets don't count as ordinary. Null ids and texts add nothing.
    """
    coded = F.base64(F.unhex(F.sha2(F.concat(F.lit("s"), F.col("id")), 256)))
    shapes = F.array(coded, F.translate(coded, "+/=", "xQ7"), F.translate(coded, "+/=", "-_"), F.upper(F.translate(coded, "+/=", "9B")), F.sha2(F.concat(F.lit("h"), F.col("id")), 224))
    secrets = spark.range(n_strings).select(F.get(shapes, (F.col("id") % 5).cast("int")).alias("text"), F.lit(True).alias("secret"))
    ids = [r[0] for r in docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(id_col).limit(n_docs).collect()]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    for _, pattern, _, _ in BASE:
        text = F.regexp_replace(text, pattern, " ")
    words = docs.where(F.col(id_col).isin(ids)).select(F.filter(split_words(text), lambda w: w.rlike("^[A-Za-z0-9_.-]{2,60}$")).alias("w"))

    def joined(w: Column) -> Column:
        pair = lambda sep, second: F.transform(w, lambda x, i: F.concat(x, F.lit(sep), second(F.coalesce(F.get(w, i + 1), F.lit("id")))))
        return F.concat(w, pair("_", F.lower), pair("", F.initcap), pair("-", F.lower), pair("/", F.lower), F.transform(pair("_", F.lower), F.upper))

    ordinary = words.select(F.explode(let(F.col("w"), joined)).alias("text"), F.lit(False).alias("secret"))
    return secrets.unionByName(ordinary)


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """The log-likelihood ratio of each pair of characters, random against ordinary; row by row, index 0 for a foreign character."""
    size = len(ALPHABET) + 1
    codes = F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = samples.where("text is not null and length(text) > 1").select("secret", F.explode(let(codes, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: x * size + F.get(c, i + 1)))).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for secret, pair, n in pairs.groupBy("secret", "pair").count().collect():
        counts[secret][pair] = n

    def logs(own: dict[int, int]) -> list[float]:
        out = []
        for a in range(size):
            row = [own.get(a * size + b, 0) + smooth for b in range(size)]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return [round(x - y, 6) for x, y in zip(logs(counts[True]), logs(counts[False]), strict=True)]


STRETCHES = "array<struct<s:int,e:int>>"


def stretches(token: Column, model: list[float], min_total: float = MIN_TOTAL) -> Column:
    """Where a token is random: (s, e), end exclusive, of each stretch whose ratios add up to ``min_total``, with the rest of the parts it ends in.

    A stretch begins where the sum so far is not above zero and ends at its highest sum; it is over when the sum is down to
    zero again, or by ``min_total`` below the highest one. Parts are what '/', '_' and '-' separate.
    """
    size = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one literal
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    kind = f"struct<sum:double,s:int,best:double,e:int,out:{STRETCHES}>"
    begin = F.expr(f"cast(struct(0, 0, 0, 0, array()) as {kind})")

    def closed(a: Column) -> Column:
        good = (a["best"] >= min_total) & (a["e"] - a["s"] >= MIN_RUN)
        return F.when(good, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        over = (a["sum"] <= 0) | (a["best"] >= min_total) & (a["best"] - a["sum"] >= min_total)
        total = F.when(over, x["r"]).otherwise(a["sum"] + x["r"])
        higher = over | (total > a["best"])
        new = F.struct(total, F.when(over, x["i"]).otherwise(a["s"]), F.when(higher, total).otherwise(a["best"]), F.when(higher, x["i"] + 2).otherwise(a["e"]), F.when(over, closed(a)).otherwise(a["out"]))
        return new.cast(kind)

    def found(c: Column) -> Column:
        steps = F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.struct(F.get(table, x * size + F.get(c, i + 1)).alias("r"), i.alias("i")))
        return F.aggregate(steps, begin, step, closed)

    def widened(raw: Column) -> Column:
        before = lambda x: x["s"] - F.length(F.regexp_extract(F.substring(token, F.lit(1), x["s"]), "[^/_-]*$", 0))
        after = lambda x: x["e"] + F.length(F.regexp_extract(F.substring(token, x["e"] + 1, F.length(token)), "^[^/_-]*", 0))
        ends = lambda x, i: F.least(after(x), F.get(raw, i + 1)["s"])
        return F.transform(raw, lambda x, i: F.struct(F.greatest(before(x), F.when(i > 0, ends(F.get(raw, i - 1), i - 1))).alias("s"), ends(x, i).alias("e")))

    return let(let(codes, found), lambda raw: F.when(F.size(raw) > 0, widened(raw)).otherwise(F.expr(f"cast(array() as {STRETCHES})")))


def scan(docs: DataFrame, model: list[float], text_col: str = "text", min_total: float = MIN_TOTAL) -> DataFrame:
    """``docs`` with __base and __spans as last columns: arrays of (start, rank, kind, end), the spans of the fixed patterns and all spans.

    A null or empty text has none; a text of any length is read whole. Repeated rows are scanned each by itself, null ids like others; an empty
    table gives no rows. Other columns pass through; if one has a name that is added here, the added one gets underscores before it.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base_name, spans_name = fresh(docs, "__base"), fresh(docs, "__spans")
    based = docs.withColumn(base_name, _base(text))

    def added(base: Column) -> Column:
        runs = _spans(text, len(BASE), "markov", RUN, inside=lambda m: stretches(m, model, min_total))
        return F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))

    return based.withColumn(spans_name, F.sort_array(F.concat(base_name, added(F.col(base_name)))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    model = train(sample(docs.sparkSession, docs)) if model is None else model

    def count(kind: str) -> Column:
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE]
    return scan(docs.select("doc_id", "text"), model).select("doc_id", *counts, F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"))

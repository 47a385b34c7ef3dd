"""Line-first quality rules, in DataFrame functions alone.

Each line is judged by itself: too many signs or exclamation marks, words that stutter, long runs without any punctuation mark,
navigation separators, boilerplate phrases. Lines that fail are removed, and a document that loses more than
half of its words with them is rejected. Base rules reject very short documents and those whose 5-word windows repeat.

Every step is a function of one row, so nothing is shuffled. Repeated windows are found by their 64-bit hashes: a document whose
window hashes are all distinct, which most are, needs no more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import SPACE, fresh, let

WINDOW = 5
MIN_WORDS = 10
#: Of a line's words: signs over 1 in 5, exclamation marks or stuttered words over 3 in 10, separators over 1 in 5.
SIGNS, SEPARATORS = "#*$%&<>", "|»›•"
SHORT_LINE, LONG_LINE = 4, 8
MARKS = "[.,!?;:…]"
#: Phrases of notices and menus in English, German, Spanish and French; a dot stands for an accented letter in either case.
BOILERPLATE = (
    "(?i)all rights reserved|cookie polic|privacy polic|terms of (use|service)|uses? cookies|enable javascript|click here|"
    "sign up (now|for)|subscribe to our|skip to (main )?content|follow us on|share this|licen[sc]ed under|copyright (\\(c\\)|©|[0-9]{4})|lorem ipsum|"
    "alle rechte vorbehalten|datenschutzerkl|verwendet cookies|hier klicken|newsletter abonnieren|"
    "todos los derechos|pol.tica de (cookies|privacidad)|utiliza cookies|haga clic|s.guenos en|"
    "tous droits r.serv|politique de confidentialit|utilise des cookies|cliquez ici|suivez-nous"
)
#: Entries of menus; none begins another one but "contact", which comes after "contacto", so a line falls into entries in one way only.
MENU = (
    "home|menu|login|log in|sign in|register|search|about(?: us)?|contacto|contact(?: us)?|next|previous|back to top|faq|help|sitemap|"
    "startseite|anmelden|suche|kontakt|impressum|weiter|inicio|buscar|siguiente|anterior|accueil|connexion|recherche|suivant"
)
#: A line of entries and signs alone. Possessive, since the engine follows a group that may give back by recursion, which a long line would let overflow.
NAVIGATION = f"(?i)^\\W*+(?:(?:{MENU})\\W*+)++$"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _count(text: Column, signs: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{signs}]+", ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which occurs twice or more, first occurrence included."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(twin(x, j - 1) | twin(x, j + 1), x["i"])), lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - i, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)

        return let(let(ordered, places), total)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, WINDOW))))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; a line without words breaks none."""

    def rules(words: Column) -> Column:
        n = F.size(words)
        stutter = F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False))))
        return (n > 0) & (
            (_count(line, SIGNS) * 5 > n)
            | (_count(line, SEPARATORS) * 5 > n)
            | ((n >= SHORT_LINE) & ((_count(line, "!") * 10 > n * 3) | (stutter * 10 > n * 3)))
            | ((n >= LONG_LINE) & ~line.rlike(MARKS))
            | line.rlike(BOILERPLATE)
            | line.rlike(NAVIGATION)
        )

    return let(split_words(line), rules)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct as last column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text.

    It is named __q, with more underscores if ``docs`` has such a column. Its text is the text without failed lines. A null text has no words
    and fails the base rules, and the struct's text is null then; an empty text fails them too. A text of any length is judged whole. Repeated
    rows are judged each by itself; an empty table gives no rows. All columns of ``docs`` pass through.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    long = lambda c: c.cast("bigint")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def counted(words: Column) -> Column:
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(F.array_join(words, ""))).alias("word_chars"),
            long(_count(text, "#*$%&|<>")).alias("n_symbols"),
            long(let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x: ~line_fails(x)).alias("lines"),
        )

    def judged(b: Column) -> Column:
        failed = (b["n_words"] < MIN_WORDS) | (b["n_repeat_words"] * 100 > b["n_words"] * 20)
        left = F.aggregate(b["lines"], F.lit(0).cast("bigint"), lambda total, x: total + F.size(split_words(x)))
        kept = F.when(failed, False).otherwise(F.coalesce(left * 2 >= b["n_words"], F.lit(False)))
        return F.struct(*(b[n].alias(n) for n in names), failed.alias("base_failed"), kept.alias("kept"), F.array_join(b["lines"], "\n").alias("text"))

    # what makes rows of an array is never computed twice, as a filter and as a column
    return docs.select("*", F.explode(F.array(let(let(split_words(text), counted), judged))).alias(fresh(docs, "__q")))


def report(docs: DataFrame) -> DataFrame:
    """Per document: its counts, base_failed and kept, under the names of the contract."""
    q = measured(docs.select("doc_id", "text"))
    return q.select("doc_id", *(f"__q.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failed lines, with their own columns; n_chars follows the text."""
    found = measured(docs)
    q = F.col(found.columns[-1])
    new = {"text": q["text"], "n_chars": F.length(q["text"]).cast("bigint")}
    return found.where(q["kept"]).select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


_W = "[\\x20\\x09-\\x0D]+"
#: The same in DuckDB's SQL, written apart from the functions above.
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_W}'), lambda x: x <> '') AS w FROM t),
win AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, w FROM w WHERE len(w) >= {WINDOW}),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM win),
dup AS (SELECT doc_id, i FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(range({WINDOW})) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t),
lw AS (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '{_W}'), lambda x: x <> '') AS v FROM lines),
judged AS (
  SELECT doc_id, line, len(v) AS n, len(v) > 0 AND (
    length(regexp_replace(line, '[^{SIGNS}]+', '', 'g')) * 5 > len(v) OR length(regexp_replace(line, '[^{SEPARATORS}]+', '', 'g')) * 5 > len(v)
    OR len(v) >= {SHORT_LINE} AND (length(regexp_replace(line, '[^!]+', '', 'g')) * 10 > len(v) * 3
      OR len(list_filter(range(2, len(v) + 1), lambda i: v[i] = v[i - 1])) * 10 > len(v) * 3)
    OR len(v) >= {LONG_LINE} AND NOT regexp_matches(line, '{MARKS}')
    OR regexp_matches(line, '{BOILERPLATE}') OR regexp_matches(line, '(?i)^\\W*(({MENU})\\W*)+$')) AS fails
  FROM lw),
per AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS left_words
  FROM judged GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    per.n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, left_words
  FROM w JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 20 AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 20) AND left_words * 2 >= n_words AS kept
FROM base
"""

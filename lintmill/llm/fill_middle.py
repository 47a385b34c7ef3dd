"""Fill-in-the-middle transformation in DataFrame functions alone.

``regexp_extract_all`` makes the array of a text's units, ``conv`` of pieces of a ``sha2`` digest of its id gives two cuts, and ``slice`` with
``array_join`` builds the arrangement: prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each after its sentinel. A text that
holds a sentinel stays plain, so every sentinel occurs once in what is written, and cutting at the sentinels gives the text back.

A function of one row: nothing is shuffled, and a row's result depends on its id and text only, so repeated rows get equal results.
Null texts count as empty and stay plain; a null id counts as an empty string. An empty table gives no rows. Texts are taken whole; the array
of units takes some 60 bytes for each unit of the one text at hand, so where texts have millions of code points, a coarser unit is the better choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import fresh, let

#: Units that a text is cut into; each pattern matches every character of any text once.
CODE_POINTS = "(?s)."
WORDS = "(?s)\\s*\\S+|\\s+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: In a hundred: texts that are rearranged, and of these the ones whose suffix comes first.
REARRANGED, SUFFIX_FIRST = 90, 20
SEED = "1:"


def _part(digest: Column, k: int) -> Column:
    """The ``k``-th group of eight hexadecimal digits, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def arranged(text: Column, key: Column, unit: str = CODE_POINTS, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> Column:
    """A struct: n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain), output."""
    text = F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)

    def cut(x: Column) -> Column:
        n = F.size(x["units"])
        first, second = (_part(x["digest"], k) % (n + 1) for k in (0, 1))
        taken = F.exists(F.array(*map(F.lit, (PREFIX, SUFFIX, MIDDLE))), lambda s: F.contains(x["text"], s))
        form = F.when((n == 0) | (_part(x["digest"], 2) % 100 >= rearranged) | taken, "plain").when(_part(x["digest"], 3) % 100 < suffix_first, "spm").otherwise("psm")
        return let(F.struct(x["units"].alias("units"), x["text"].alias("text"), n.alias("n"), F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"), form.alias("form")), split)

    def split(x: Column) -> Column:
        part = lambda start, length: F.array_join(F.slice(x["units"], start, length), "")
        pieces = F.struct(part(F.lit(1), x["a"]).alias("prefix"), part(x["a"] + 1, x["b"] - x["a"]).alias("middle"), part(x["b"] + 1, x["n"] - x["b"]).alias("suffix"))
        plain = F.struct(x["n"].cast("bigint").alias("n"), x["form"].alias("form"), F.lit(None).cast("bigint").alias("prefix_chars"), F.lit(None).cast("bigint").alias("middle_chars"), x["text"].alias("output"))

        def joined(p: Column) -> Column:
            psm = F.concat(F.lit(PREFIX), p["prefix"], F.lit(SUFFIX), p["suffix"], F.lit(MIDDLE), p["middle"])
            spm = F.concat(F.lit(SUFFIX), p["suffix"], F.lit(PREFIX), p["prefix"], F.lit(MIDDLE), p["middle"])
            lengths = (F.length(p[c]).cast("bigint").alias(f"{c}_chars") for c in ("prefix", "middle"))
            return F.struct(x["n"].cast("bigint").alias("n"), x["form"].alias("form"), *lengths, F.when(x["form"] == "psm", psm).otherwise(spm).alias("output"))

        return F.when(x["form"] == "plain", plain).otherwise(let(pieces, joined))

    return let(F.struct(F.regexp_extract_all(text, F.lit(unit), F.lit(0)).alias("units"), digest.alias("digest"), text.alias("text")), cut)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone."""
    body, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    before = lambda sentinel: F.substring_index(body, sentinel, 1)
    after = lambda sentinel: F.substring_index(body, sentinel, -1)
    psm = F.concat(F.replace(before(SUFFIX), F.lit(PREFIX), F.lit("")), middle, after(SUFFIX))
    spm = F.concat(after(PREFIX), middle, F.replace(before(PREFIX), F.lit(SUFFIX), F.lit("")))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with a struct of ``arranged`` as last column, named __fim with more underscores if ``docs`` has such a column."""
    # a row of an array is computed once, however often its fields are used afterwards
    return docs.select("*", F.explode(F.array(arranged(F.col(f"`{text_col}`"), F.col(f"`{id_col}`"), **options))).alias(fresh(docs, "__fim")))


def report(docs: DataFrame) -> DataFrame:
    """Per document: units, form, cuts, and digests of the output and of the text restored from it."""
    out = transform(docs.select("doc_id", "text"))
    x = F.col("__fim")
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", *(x[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")), digest(x["output"]).alias("output_sha256"), digest(restored(x["output"], x["form"])).alias("restored_sha256"))


#: The same in DuckDB's SQL, written apart from the functions above.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS y, CAST('0x' || d[17:24] AS BIGINT) % 100 AS u, CAST('0x' || d[25:32] AS BIGINT) % 100 AS v FROM t),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

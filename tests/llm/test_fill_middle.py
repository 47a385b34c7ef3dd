"""Fill-in-the-middle against brute force, its SQL and exact round trips."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lintmill.llm import fill_middle
from lintmill.llm.queries import ORACLES, QUERIES
from tests.helpers import duck_rows, spark_rows


def brute(doc_id, text):
    """In plain Python: Python's strings are code points already."""
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    return n, form, a, b - a, sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text)


def test_the_query_equals_its_sql_and_brute_force(spark, duck, sf_dir, documents):
    got = QUERIES["op11_fill_middle"](spark, sf_dir)
    assert spark_rows(got) == duck_rows(duck.sql(ORACLES["op11_fill_middle"]))
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert rows == {r.doc_id: brute(r.doc_id, r.text) for r in documents} and {x[1] for x in rows.values()} == {"plain", "psm", "spm"}


def test_odd_rows(odd, empty):
    got = sorted((repr(tuple(r)) for r in fill_middle.report(odd).collect()))
    assert got == sorted(repr((r.doc_id, *brute(r.doc_id, r.text))) for r in odd.collect())
    assert fill_middle.report(empty).count() == 0 and fill_middle.transform(odd).columns[: len(odd.columns)] == odd.columns


def test_sentinels_brackets_and_wide_characters(spark):
    texts = ["<", "<P", "a<S", "<M><", "x<P>y", "<S>", "tail <M>", "<<<>>>PSM<P", "\r\n\r\n", "\x00\x1f", "😀é\U0010ffff日本", "é‍"] * 40
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: tuple(r)[1:] for r in fill_middle.report(rows).collect()} == {i: brute(i, t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("unit", [fill_middle.CODE_POINTS, fill_middle.WORDS])
def test_every_text_comes_back_from_its_output(spark, unit):
    texts = [f" lead\n two  words {i}   end <" * (i % 7) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("__fim", F.lit(1))
    out = fill_middle.transform(rows, unit=unit, rearranged=100, suffix_first=50)
    x = F.col("___fim")
    back = out.select("text", x["form"].alias("form"), x["output"].alias("output"), fill_middle.restored(x["output"], x["form"]).alias("back")).collect()
    assert all(r.text == r.back for r in back) and {r.form for r in back} == {"plain", "psm", "spm"}
    assert all((r.form == "plain") == (r.text == "") for r in back) and all(r.output.count(s) == 1 for r in back if r.form != "plain" for s in ("<P>", "<S>", "<M>"))


def test_the_plan_has_no_python_and_no_shuffle(spark, sf_dir):
    plan = QUERIES["op11_fill_middle"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

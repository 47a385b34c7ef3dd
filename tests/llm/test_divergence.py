"""The source divergence audit against its SQL and against brute force in Python's integers."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from lintmill.llm import divergence
from lintmill.llm.queries import ORACLES, QUERIES
from tests.helpers import duck_rows, spark_rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """rows: (text, lang, source). Every kept term of every pair is written out."""
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang, sources in groups.items():
        terms = [w for (x, w), n in docs.items() if x == lang and n >= 10]
        own = {s: {w: counts[lang, s][w] for w in terms} for s in sources}
        own[None] = {w: sum(own[s][w] for s in sources) for w in terms}
        p = {s: {w: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(terms)) for w, n in c.items()} for s, c in own.items()}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [("pair", o, sum(gap(p[s][w], p[o][w]) for w in terms)) for o in sources - {s}]
            above = [("term", w, gap(p[s][w], p[None][w])) for w in terms if own[s][w] and p[s][w] > p[None][w]]
            for part, most in ((pairs, None), (above, 10)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most]
                out |= {(lang, s, kind, item, value, i) for i, (kind, item, value) in enumerate(ranked, 1)}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_the_query_equals_its_sql_and_brute_force(spark, duck, sf_dir):
    got = QUERIES["op12_divergence"](spark, sf_dir)
    assert spark_rows(got) == duck_rows(duck.sql(ORACLES["op12_divergence"]))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()
    assert result(got) == brute([tuple(r) for r in docs])


@pytest.mark.parametrize("most", [0, 100_000])
def test_odd_rows_and_many_sources(spark, monkeypatch, most):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", most)
    rows = [(f"Common WORD{'abc'[i % 3]} été {'x' * (i % 5)}{'É' * (i % 2)} " * (1 + i % 4), "en", f"s{i % 37}", "t", 1) for i in range(400)]
    rows += [("common common worda", "en", "hot", "u", 2)] * 300 + [(None, "en", "hot", None, None), ("", "en", "silent", None, 3), ("123 ___ @[`{\x7f", "en", None, "", 4)]
    rows += [("rare words only here", "de", "a", None, 5), (None, "de", "b", None, 6), (None, None, None, None, 7), ("long " * 50_000, None, "s", None, 8)] + [("日本語 😀x", "ja", s, None, 9) for s in "pqp" * 5]
    schema = "text string, lang string, source string, term string, n int"
    df = spark.createDataFrame(rows, schema)
    assert result(divergence.divergence(df.repartition(5))) == brute([r[:3] for r in rows])
    renamed = df.toDF("body", "tongue", "site", "lang", "docs")
    assert result(divergence.divergence(renamed, "tongue", "site", "body")) == brute([r[:3] for r in rows])


def test_an_empty_table_and_one_without_kept_terms(spark):
    schema = "text string, lang string, source string"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    rows = [("one two", "en", "a"), ("three", "en", "b"), ("four", "en", "c")]
    assert result(divergence.divergence(spark.createDataFrame(rows, schema))) == brute(rows) == {("en", s, "pair", o, 0, i) for s in "abc" for i, o in enumerate(sorted(set("abc") - {s}), 1)}


def sorted_rows(keys):
    columns = [pa.array([k[i] for k in keys]) for i in range(3)]
    ones = pa.array(np.ones(len(keys), dtype=np.int64))
    return pa.RecordBatch.from_arrays([*columns, ones, ones], names=["lang", "term", "source", "docs", "n"])


@pytest.mark.parametrize("rows", [1, 4, 16, 1000])
def test_chunks_hold_whole_runs(rows):
    """A run far longer than a chunk, in batches of any size, is added up and not cut."""
    keys = sorted([("en", f"w{i % 9}", f"s{i % 3}") for i in range(90)] + [("en", "hot", f"s{i % 2}") for i in range(500)] + [("fr", "hot", "s0")] * 7)
    batches = [sorted_rows(keys[i : i + 13]) for i in range(0, len(keys), 13)]
    got, seen = collections.Counter(), []
    for table in divergence._chunks(iter(batches), rows):
        merged = divergence._merged(table)
        runs = list(dict.fromkeys(zip(merged["lang"].to_pylist(), merged["term"].to_pylist(), strict=True)))
        assert not set(runs) & set(seen)
        seen += runs
        for r in merged.to_pylist():
            got[r["lang"], r["term"], r["source"]] += r["n"]
    assert got == collections.Counter(keys)


def test_terms_of_a_batch():
    texts = ["", None, "Ab1cd", "é", "x", "_", "y Z", "", "end"]
    terms, doc = divergence._terms(divergence._bytes(pa.array(texts).slice(1)))
    want = [(i, w.encode()) for i, t in enumerate(texts[1:]) for w in TERM.findall((t or "").translate(LOWER))]
    assert list(zip(doc.tolist(), terms.to_pylist(), strict=True)) == want


def test_shares_are_exact_far_beyond_a_product_in_64_bits():
    counts, total, terms = np.array([0, 1, 10**12 + 7, 8 * 10**15], dtype=np.int64), np.int64(8 * 10**15 + 5), np.int64(10**9 + 1)
    assert divergence.share(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (int(total) + 2 * int(terms)) for c in counts]

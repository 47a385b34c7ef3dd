"""The pipeline's stages one after the other on a small table with planted cases."""

import collections
import itertools
import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lintmill.llm import quality
from lintmill.llm.common import written
from lintmill.llm.queries import tokenizer_path


def test_stages_take_effect(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    sentence = lambda tag: " ".join(f"The {tag}{i}a word {tag}{i}b goes {tag}{i}c then {tag}{i}d, and {tag}{i}e." for i in range(12))
    passage = "A long passage, " + " ".join(f"with word{i}" for i in range(40)) + "."
    near = sentence("near").replace("near5b", "other")
    planted = {9001: sentence("one"), 9002: sentence("near"), 9003: near, 9004: f"{sentence('two')}\n{passage}", 9005: f"{sentence('three')}\n{passage}", 9006: f"{sentence('four')} {item}", 9007: "### $$$ *** " * 30, 9008: None}
    rows = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted.items()], source.schema)
    docs = rows.unionByName(source.where("doc_id < 40"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen.append({r.doc_id: r.text for r in docs.where("doc_id > 9000").collect()} if name != "packing" else {r.doc_id for r in docs.where("doc_id > 9000").select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == source.columns and docs.where(F.length("text") != F.col("n_chars")).count() == 0
    quality, lines, near_copies, benchmarks, packed = seen
    assert set(quality) == {9001, 9002, 9003, 9004, 9005, 9006}
    assert lines[9004] == planted[9004] and lines[9005] == sentence("three")
    assert set(near_copies) == {9001, 9002, 9004, 9005, 9006}
    assert set(benchmarks) == packed == {9001, 9002, 9004, 9005}


def test_run_returns_pieces(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


WS = " \t\n\r\x0b\x0c"


def split(text):
    return [w for w in re.split("[ \t-\r]+", text) if w]


def brute_clean(rows):
    """The quality stage in plain Python: (id, text) of what it keeps."""
    out = []
    for i, text in rows:
        words = split(text or "")
        windows, covered = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)), set()
        for k in range(len(words) - 4):
            if windows[tuple(words[k : k + 5])] > 1:
                covered.update(range(k, k + 5))
        if len(words) < 10 or 100 * len(covered) > 20 * len(words):
            continue
        left = []
        for line in text.split("\n"):
            w = split(line)
            n, count = len(w), lambda signs, line=line: sum(line.count(c) for c in signs)
            stutter = sum(a == b for a, b in itertools.pairwise(w))
            bad = count("#*$%&<>") * 5 > n or count("|»›•") * 5 > n or (n >= 4 and (count("!") * 10 > 3 * n or stutter * 10 > 3 * n)) or (n >= 8 and not re.search("[.,!?;:…]", line))
            bad = bad or re.search(quality.BOILERPLATE, line, re.A) or re.search(quality.NAVIGATION, line, re.A)
            if not (n and bad):
                left.append(line)
        if 2 * sum(len(split(x)) for x in left) >= len(words):
            out.append((i, "\n".join(left)))
    return out


def brute_dedup(rows):
    """The line stage: texts without lines of runs of fifty words that an earlier place has."""
    seen, kept, out = collections.defaultdict(list), {}, []
    for i, text in sorted(rows):
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(WS)]
        own = kept[i] = [(lines[k].strip(WS), len(split(lines[k]))) for k in at]
        gone = set()
        for s in range(len(own)):
            for j, p in seen[own[s][0]]:
                k = 0
                while s + k < len(own) and p + k < len(kept[j]) and own[s + k][0] == kept[j][p + k][0]:
                    k += 1
                if sum(x[1] for x in own[s : s + k]) >= 50:
                    gone.update(at[s : s + k])
            seen[own[s][0]].append((i, s))
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text))
    return out


def brute_copies(rows):
    """The near-copy stage: the smallest id of each component of texts whose five-word shingles agree by four fifths."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows if (w := split("".join(c.lower() if c.isascii() else c for c in t)))}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if find(i) == i]


def brute_benchmark(rows, items):
    """The benchmark stage: documents that hold no ten words, or whole shorter item, of the benchmark."""
    cut = lambda t: [w for w in re.split("[\x00-/:-`{-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in map(cut, items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    return [(i, t) for i, t in rows if not any(tuple(w[k : k + m]) in windows for w in [cut(t)] for m in sizes for k in range(len(w) - m + 1))]


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage on what the one before it wrote, over the whole table, against plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    brute = [brute_clean, brute_dedup, brute_copies, lambda rows: brute_benchmark(rows, items)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], brute, strict=True):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = written(stage(spark, docs, sf_dir), name)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(plain(before)), name
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in docs.collect()}
    spans, fills = collections.defaultdict(list), collections.Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes()
        spans[r.doc_id].append((r.start, r.start + r.length))
        fills[r.sequence_id] += r.length
    assert {i: sorted(s) for i, s in spans.items()}.keys() == ids.keys() and max(fills.values()) <= 1024
    for i, s in spans.items():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] == len(ids[i]) and all(a[1] == b[0] for a, b in itertools.pairwise(s))

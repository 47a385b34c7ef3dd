"""The operators in free style, against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintmill.llm import decontaminate, html_extract, jaccard, lm, packing, training_order, warc
from lintmill.llm.queries import QUERIES, tokenizer_path

# --- n-gram Jaccard join ---------------------------------------------------------------------------------------------------------------


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_components(rows, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(n, seed, words=60, edits=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(3, words))] for _ in range(max(2, n // 12))]
    passage = [r.choice(vocabulary) for _ in range(12)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, " ".join(w + (passage if i % 3 == 0 else []))))
    return out


@pytest.mark.parametrize("k,num,seed", [(4, 85, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, k, num, seed):
    rows = near_copies(240, seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k=k, num=num, den=100).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_large_groups_go_by_blocks_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rows = near_copies(150, 3, words=30, edits=2)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k=4, num=85, den=100).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_components_of_the_test_table(spark, sf_dir, documents):
    got = {r.doc_id: tuple(r)[1:3] for r in QUERIES["op1_jaccard"](spark, sf_dir).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in documents], 4, 85, 100)


def test_components_of_odd_rows(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()]
    assert len(got) == odd.count()
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3)} <= set(got) and {d: c for d, _, c in got if d in (5, 6, 7, 8, 9)} == {5: 5, 6: 5, 7: 7, 8: 7, 9: 7}
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.drop_near_copies(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 0, 1, 2, 3, 4, 5, 7, 10, 11}


def test_tree_bounds_never_prune_a_link():
    r = random.Random(9)
    sets = [np.array(sorted(r.sample(range(1 << 40), r.randint(1, 40))), dtype=np.uint64) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], np.array([r.randrange(1 << 40)], dtype=np.uint64)])) for s in sets]
    sizes, maps = np.array(list(map(len, sets))), jaccard._bitmaps([jaccard.signature(s) for s in sets])
    tree, label = jaccard.Tree(sizes, maps), np.arange(len(sets))
    found = {tuple(sorted(p)) for i, j in jaccard.candidates(tree, tree, 80, 100, label, label) for p in zip(i.tolist(), j.tolist(), strict=True)}
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard.links(sets[i], sets[j], 80, 100)}
    assert true <= found and len(found) < len(sets) * (len(sets) - 1) // 2


# --- decontamination -------------------------------------------------------------------------------------------------------------------


def brute_hits(text, items, window):
    w = decontaminate.words((text or "").encode())
    hit, found = set(), set()
    for name, item in items:
        v = decontaminate.words(item.encode())
        m = min(window, len(v))
        for s in range(len(v) - m + 1 if v else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[s : s + m]:
                    hit.update(range(i, i + m))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abcdefg") for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 14]))) for i in range(12)] + [(30, "Ab-C d"), (7, "repeated id " * 6)]
    docs = [(i, text(r.randint(0, 60)) + (" " + items[i % 12][1] if i % 2 else "")) for i in range(60)] + [(98, None), (99, "")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {i: brute_hits(t, items, 10) for i, t in docs}
    for options in ({}, {"block_bytes": 20}):
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.report(d, b, **options).collect()}
        assert got == {i: (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, (n, h, f) in want.items()}


def test_longest_matches(spark):
    words = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(1, "x y " + " ".join(words[5:25]) + " z")], "doc_id bigint, text string")
    b = spark.createDataFrame([("q", " ".join(words))], "item_id string, text string")
    row = decontaminate.report(d, b).first()
    assert [tuple(m) for m in row.matches] == [("q", 5, 2, 20)] and row.n_hit == 20
    assert decontaminate.decontaminate(d, b).count() == 0 and decontaminate.decontaminate(d, b.limit(0)).count() == 1


def brute_matches(text, items, window):
    """Every stretch of a document that an item has, at least a window long, within no longer one; the least id and place of those that have it."""
    w, found = decontaminate.words((text or "").encode()), {}
    for name, item in items:
        v = decontaminate.words(item.encode())
        m = min(window, len(v))
        for s in range(len(w)):
            for p in range(len(v)):
                n = 0
                while s + n < len(w) and p + n < len(v) and w[s + n] == v[p + n]:
                    n += 1
                if v and n >= m:
                    found[s, s + n] = min(found.get((s, s + n), (str(name), p)), (str(name), p))
    return [(name, p, s, e - s) for (s, e), (name, p) in sorted(found.items()) if not any(a <= s and e <= b and (a, b) != (s, e) for a, b in found)]


def test_matches_are_the_same_for_any_block_size(spark):
    r = random.Random(11)
    shared = [f"s{i}" for i in range(30)]
    text = lambda n: [r.choice("abc") for _ in range(n)]
    items = [(f"i{i}", " ".join([*text(i), *shared[i : 30 - i], *text(5)])) for i in range(6)] + [(f"k{i}", " ".join(text(r.choice([2, 12, 20])))) for i in range(8)] + [("i2", " ".join(shared))]
    docs = [(i, " ".join([*text(r.randint(0, 30)), *(shared if i % 3 else shared[3:22]), *text(r.randint(0, 15))])) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = {i: brute_matches(t, items, 10) for i, t in docs}
    for size in (decontaminate.BLOCK_BYTES, 400, 60):
        rows = decontaminate.report(d, b.orderBy(F.rand(size)), block_bytes=size).collect()
        assert {x.doc_id: [tuple(m) for m in x.matches] for x in rows} == want


def test_decontamination_of_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, "tail words here"), (None, "one"), (2, None)], "item_id bigint, text string")
    kept = decontaminate.decontaminate(odd, b)
    assert kept.columns == odd.columns and 6 not in {r.doc_id for r in kept.collect()} and kept.count() == odd.count() - 1
    assert decontaminate.decontaminate(empty, b).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    pool = [*"ab1é!'\n \t\x85\xa0\x1c\x1d ​#_<>", "'s", "<|endoftext|>", "  ", "日本", "١", "\r\n", "word", "Word,", " ###"]
    r = random.Random(1)
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    whole = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    assert packing.Encoder(tokenizer_path()).encode(texts) == [np.array([*e.ids, 0], dtype="<u4").tobytes() for e in whole]


def check_pieces(rows, ids_of, capacity=1024):
    """Every id lies in one piece, offsets have no gaps; gives the share of padding."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, ids in ids_of.items():
        own = sorted(by_doc.pop(doc), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == ids and all(r["doc_tokens"] * 4 == len(ids) for r in own)
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
    assert not by_doc
    fills = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        fills.append(sum(r["length"] for r in own))
    assert max(fills) <= capacity
    return 1 - sum(fills) / (capacity * len(fills))


def test_packing_is_a_partition_of_all_ids(spark, documents):
    df = spark.createDataFrame([(r.doc_id, r.text) for r in documents], "doc_id bigint, text string").repartition(2)
    encoder = packing.Encoder(tokenizer_path())
    ids = dict(zip([r.doc_id for r in documents], encoder.encode([r.text or "" for r in documents]), strict=True))
    assert check_pieces([r.asDict() for r in packing.pack(df, tokenizer_path()).collect()], ids) < 0.02


def test_placement_minimises_the_sum_of_squares():
    r, capacity = random.Random(2), 12
    levels = packing.Levels(capacity)
    for step in range(400):
        s = r.randint(1, capacity - 1)
        before = levels.count[:capacity].copy()

        def squares(h, before=before, s=s):
            n = before.copy()
            n[h] -= h > 0
            if h + s < capacity:
                n[h + s] += 1
            return int((n[1:] ** 2).sum())

        best = min(squares(h) for h in range(capacity - s + 1) if h == 0 or before[h] > 0)
        levels.place((step, 0, b"", s), s)
        assert int((levels.count[1:capacity] ** 2).sum()) == best


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack(odd, tokenizer_path(), open_limit=2).collect()
    assert {r.doc_id: r.doc_tokens for r in rows}[0] == 1 and sum(r.length for r in rows if r.doc_id == 3) == 4
    assert packing.pack(empty, tokenizer_path()).count() == 0


# --- archives --------------------------------------------------------------------------------------------------------------------------


def test_archives_of_both_versions_parse_by_declared_length():
    rows = [(1, "http://a/b c", b"x\n\nhttp://fake 0.0.0.0 20240101000000 text/html 3\nabc"), (None, None, b""), (3, "http://c", bytes(range(256)))]
    for version in (1, 2):
        data = warc.write_arc("n.arc", rows, version)
        for stored in (data, zlib.compress(data, wbits=31)):
            got = [warc.convert(r) for r in warc.parse_arc(stored)]
            assert [(g[0], g[-1], g[8]) for g in got] == [(k, p, base64.b32encode(hashlib.sha1(p).digest()).decode()) for k, _, p in rows]
            assert [g[2] for g in got] == ["response"] * 3 and got[0][3] == "http://a/b%20c" and got[0][4] == "2024-01-01T00:00:00Z"
    assert list(warc.parse_arc(b"noise\nhttp://x 1.1.1.1 20200101 text/plain 99\nshort"))[0]["block"] == b"short"
    assert list(warc.parse_arc(b"")) == []


def test_header_lines_with_blanks_and_bad_dates():
    one = b"filedesc://x.arc 0.0.0.0 19990203040506 text/plain 77\n" + (about := b"1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n").ljust(77, b" ")
    lines = [
        (b"http://a/ 1.2.3.4 20000101000000 text/html; charset=utf-8 4", ("http://a/", "1.2.3.4", "2000-01-01T00:00:00Z", "text/html; charset=utf-8")),
        (b"http://a/b c 1.2.3.4 5 10.0.0.1 2001 text/plain 4", ("http://a/b c 1.2.3.4 5", "10.0.0.1", "2001-01-01T00:00:00Z", "text/plain")),
        (b"http://v6/ 2001:db8::1 20011301000000 text/plain 4", ("http://v6/", "2001:db8::1", "1999-02-03T04:05:06Z", "text/plain")),
        (b"http://none/ - 2001020301 a b c 4", ("http://none/", "-", "2001-02-03T01:00:00Z", "a b c")),
    ]
    data = one + b"\n" + b"http://bad/ 1.2.3.4 2000010100000099 text/html 4\nthis\n" + b"".join(x + b"\nbody\n" for x, _ in lines)
    got = [(r[3], r[5], r[4], r[6]) for r in map(warc.convert, warc.parse_arc(data))]
    assert about and got == [want for _, want in lines]
    two = b"filedesc://x.arc 0.0.0.0 19990203040506 text/plain 200 - - 0 x.arc 9\n2 0 me\n\n\n" + b"http://a b/ 1.2.3.4 20000101 text/html; x=y 404 sum - 12 x.arc 4\nbody\n"
    assert [(r["URL"], r["Content-type"], r["Result-code"], r["Offset"], r["block"]) for r in warc.parse_arc(two)] == [(b"http://a b/", b"text/html; x=y", b"404", b"12", b"body")]


def test_archive_round_trip_with_revisits(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages += [(i + 1000, "http://other", h) for i, _, h in pages[:9]] + [(2000, None, None), (2001, "u v", ""), (2002, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: tuple(r)[1:5] for r in warc.round_trip(df).collect()}
    first, want = {}, {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        body = (h or "").encode()
        own = base64.b32encode(hashlib.sha1(body).digest()).decode()
        f = first.setdefault(own, i)
        want[i] = (len(body), own, "response" if f == i else "revisit", None if f == i else f)
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


# --- language model --------------------------------------------------------------------------------------------------------------------


def test_scores(spark, sf_dir, documents):
    got = {r.doc_id: r for r in QUERIES["op7_lm"](spark, sf_dir).collect()}
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), b""] for r in documents}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = collections.Counter(w for i, own in texts.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.fixture(scope="module")
def language(spark, documents):
    """A model of a part of the documents, and its texts as words with the end of each, training or not."""
    docs = [(r.doc_id, r.text) for r in documents[:120]]
    rows = [(i, zlib.crc32(str(i).encode()) % 10 == 0, t) for i, t in docs]
    limit, lm.COMMON = lm.COMMON, 400
    lm.common_words.__defaults__ = (400, lm.COMMON_BYTES)
    try:
        texts, lexicon, model, common = lm.trained(spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string"))
        scores = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    finally:
        lm.COMMON = limit
        lm.common_words.__defaults__ = (limit, lm.COMMON_BYTES)
    words = {w: int(model.classes[i]) for i, (w, _) in enumerate(common)} | {r.word: r["class"] for r in lexicon.collect()}
    cut = {i: (held, [x.decode() for x in (t or "").encode().lower().split()]) for i, held, t in rows}
    return model, words, cut, scores, len(common)


def class_bigrams(cut, words, size):
    table = np.zeros((size, size))
    for held, own in cut.values():
        if not held:
            line = [0, *(words[w] for w in own), 0]
            for x, y in itertools.pairwise(line):
                table[x, y] += 1
    return table


def test_every_training_word_has_a_class_and_scores_equal_brute_force(language):
    model, words, cut, scores, n_common = language
    counts = collections.Counter(w for held, own in cut.values() if not held for w in [*own, ""])
    assert set(words) == set(counts) - {""} and n_common < len(words) / 2
    table, k = class_bigrams(cut, words, model.k), model.k
    assert {c for c in words.values()} <= set(range(1, k))
    kinds, seen = collections.Counter(words.values()), table.sum(0)
    kinds[0] = 1
    share = (seen + 1) / (seen.sum() + k)
    unknown = min((c for c in range(1, k)), key=lambda c: (-kinds[c], c))
    for i, (_, own) in cut.items():
        before, total = 0, 0.0
        for w in [*own, ""]:
            c = words.get(w, unknown) if w else 0
            total += math.log10((table[before, c] + lm.PRIOR * share[c]) / (table[before].sum() + lm.PRIOR))
            total += math.log10((counts[w] + lm.ADD) / (seen[c] + lm.ADD * (kinds[c] + 1)))
            before = c
        assert math.isclose(scores[i].score, total, rel_tol=1e-9)


def test_scores_are_a_distribution(language):
    """Over the training words of a class and one unknown word, and over all classes after any class, the probabilities sum to one."""
    model, words, cut, _, _ = language
    counts = collections.Counter(w for held, own in cut.values() if not held for w in own)
    table = class_bigrams(cut, words, model.k)
    model.set_table(table)
    emission = np.full(model.k, lm.ADD) / 10**model.mass
    for w, c in words.items():
        emission[c] += (counts[w] + lm.ADD) / 10 ** model.mass[c]
    assert np.allclose(emission[1:], 1) and np.allclose((10**model.step).sum(1), 1)


def test_other_words_go_where_their_neighbours_are_most_likely(spark):
    """Words of two kinds take turns; rare ones are classed with the frequent words that stand in the same places."""
    r = random.Random(5)
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    docs = [" ".join(f"{r.choice(left)} {r.choice(right)}" for _ in range(60)) + f" rarel{i} {r.choice(right)} {r.choice(left)} rarer{i} {r.choice(left)} {r.choice(right)}" for i in range(150)]
    rows = [(i, False, t) for i, t in enumerate(docs)]
    lm.common_words.__defaults__ = (60, lm.COMMON_BYTES)
    try:
        _, lexicon, model, common = lm.trained(spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string"))
    finally:
        lm.common_words.__defaults__ = (lm.COMMON, lm.COMMON_BYTES)
    lefts = {int(model.classes[i]) for i, (w, _) in enumerate(common) if w[0] == "l"}
    rights = {int(model.classes[i]) for i, (w, _) in enumerate(common) if w[0] == "r"}
    found = lexicon.collect()
    assert not lefts & rights and len(found) == 300 and {r.n for r in found} == {1}
    assert all((r["class"] in lefts) == (r.word.startswith("rarel")) and r["class"] in lefts | rights for r in found)


def test_exchange_never_lowers_the_likelihood():
    r = np.random.default_rng(3)
    groups = r.integers(1, 4, 30)
    bigrams = r.poisson(1 + 20 * (groups[:, None] == groups[None, :] % 3 + 1)).astype(float)

    def value(where):
        member = np.eye(17)[where]
        return lm.likelihood(member.T @ bigrams @ member)

    start = lm.exchange(bigrams, 16, sweeps=0)
    once, whole = lm.exchange(bigrams, 16, sweeps=1), lm.exchange(bigrams, 16)
    assert value(whole) >= value(once) > value(start) and (lm.exchange(bigrams, 16, sweeps=100) == whole).all()


def test_words_are_cut_as_bytes_are():
    texts = [None, "", " a  b\n", "A\x0bB\x0cc\rd", "x\u3000y\xa0z \x1cq", "É É", "no"]
    flat, at = lm.split(lm.pa.array(texts))
    assert [flat[x:y].to_pylist() for x, y in itertools.pairwise(at.tolist())] == [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    cut, at = lm.split(lm.pa.array(texts).slice(3))
    assert [cut[x:y].to_pylist() for x, y in itertools.pairwise(at.tolist())] == [[w.decode() for w in t.encode().lower().split()] for t in texts[3:]]


def test_scores_of_odd_rows(odd, empty):
    got = lm.score(odd).collect()
    assert len(got) == odd.count() and {r.doc_id: r.n_tokens for r in got}[0] == 1 and all(math.isfinite(r.score) for r in got)
    assert lm.score(empty).count() == 0


# --- pages -----------------------------------------------------------------------------------------------------------------------------


def test_minimum_cut_equals_brute_force():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 8)
        gain = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(side, gain=gain, edges=edges):
            return sum(max(-g, 0) if s else max(g, 0) for g, s in zip(gain, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])

        assert math.isclose(cost(html_extract.min_cut(gain, edges)), min(map(cost, itertools.product([False, True], repeat=n))), abs_tol=1e-6)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=#>Home</a> <a>About</a></nav><div class="cookie-notice">We use cookies.</div>
<div id=main><div class="post-content"><h2>A &quot;title&quot;</h2><p>First   paragraph, with <a href=x>a link</a> &amp; more&nbsp;words.<p>Second<br>one.<div class="ad">Buy now!</div>
<ul><li>An item.<li>Another <b>item</b>.</ul><script>if (a<b) { "</p>" }</script><form>Name <input></form><p hidden>secret</p></div>
<section id="comments"><p>I think this is great, really, thanks a lot for all of this.</p></section></div><aside>Side</aside><footer>&copy; x</footer></body>"""


def test_page_with_all_kinds_of_boilerplate():
    assert html_extract.extract(PAGE, [0.0] * html_extract.N_FEATURES) == 'A "title"\nFirst paragraph, with a link & more words.\nSecond one.\nAn item.\nAnother item.'


@pytest.mark.parametrize("start,end", [("<form action=x>", "</form>"), ('<div class="page-with-sidebar">', "</div>"), ('<form><div class="sidebar-layout"><section>', "</section></div></form>")])
def test_page_in_a_wrapper_that_looks_like_boilerplate(start, end):
    zeros = [0.0] * html_extract.N_FEATURES
    expected = html_extract.extract(PAGE, zeros)
    wrapped = PAGE.replace('<body class="has-sidebar">', "<body>" + start).replace("</body>", end + "</body>")
    assert expected and html_extract.extract(wrapped, zeros) == expected
    prose = "<nav><a href=#>Home</a></nav><p>" + "<p>".join(f"A long sentence, number {i}, that only its words, not its tags, show to be the text of the page." for i in range(5)) + "<footer>© x | y</footer>"
    weights = [0.0, 1.0, -3.0, 1.0, -1.0, 1.0, 0.0, 0.0, -2.0]
    expected = html_extract.extract(f"<body>{prose}</body>", weights)
    assert expected.count("number") == 5 and html_extract.extract(f"<body>{start}{prose}{end}</body>", weights) == expected


def test_text_and_neighbours_outweigh_a_container():
    text = "A long sentence, with commas, that goes on and on as only the running text of an article ever does, and then it ends."
    around = f"<article><div><p>{text}</p><p>{text}</p><div class=sidebar>%s</div><p>{text}</p><p>{text}</p></div><p hidden>{text}</p></article>"
    weights = [0.0, 1.0, -3.0, 1.0, -1.0, 1.0, 0.0, 0.0, -2.0]
    assert html_extract.extract(around % text, weights).count("A long") == 5
    assert "Menu" not in html_extract.extract(around % "Menu", weights)


@pytest.mark.parametrize("html,text", [("", ""), ("plain text", ""), ("<article>x", "x"), ("<article><p>a<!-- c --><p>b &lt;i&gt; <", "a\nb <i> <"), ("<article><p>" + "<b>" * 3000 + "deep</article>", "deep"), ("<<<>>>&&&", "")])
def test_broken_pages(html, text):
    got = html_extract.extract(html, [0.0] * html_extract.N_FEATURES)
    assert got == text


def test_pages_of_the_test_table(spark, sf_dir):
    import html as h
    import re

    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op10_html"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", body)]
        text = "\n".join(p for p in parts if p)
        assert got[r.page_id] == (text, len(text))


def test_pages_with_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", None, "t", 5), (1, "u", PAGE, "t", 5), (None, None, "", None, None)], "page_id bigint, url string, html string, text string, n_chars bigint")
    assert sorted(r.n_chars for r in html_extract.extract_text(rows).collect())[:2] == [0, 0]
    assert html_extract.extract_text(rows.limit(0)).count() == 0


def plain(html):
    """A page without any semantic element or name."""
    return re.sub(r"<(/?)(article|nav|footer|main|aside|header)\b[^>]*>", r"<\1div>", re.sub(r' (class|id)="[^"]*"', "", html))


def test_the_cut_corrects_labels_of_pages_without_semantic_elements(spark, sf_dir, monkeypatch):
    """Truth is what the same pages' own elements say; the ties must mend more labels than they spoil, and maximum flow must run."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").select("html").collect()]
    weights = html_extract.train(pages)
    flows, flow = [], html_extract._max_flow_side
    monkeypatch.setattr(html_extract, "_max_flow_side", lambda *a: flows.append(1) or flow(*a))
    wrong = wrong_alone = changed = 0
    for page in pages:
        truth = {b.text for b in html_extract.blocks_of(page) if b.article and not b.chrome}
        blocks, alone = html_extract.blocks_of(plain(page)), []
        found = html_extract.label(blocks, weights, alone)
        wrong += sum((b.text in truth) != x for b, x in zip(blocks, found, strict=True))
        wrong_alone += sum((b.text in truth) != x for b, x in zip(blocks, alone, strict=True))
        changed += sum(x != y for x, y in zip(found, alone, strict=True))
    assert changed > 0 and flows and wrong < wrong_alone


@pytest.mark.parametrize(
    "part",
    [
        '<h2 id="related-work">Related work of others</h2><p>It is told here, in a long sentence with commas, and it ends.</p>',
        '<section id="social-history"><p>The history of the society, in a long sentence with commas, is told here.</p></section>',
        '<section id="related-work"><p>The work of others, in a long sentence with commas, is told here.</p></section>',
        "<p>We have <math><mi>x</mi><mo>=</mo><mn>1</mn></math> in this long sentence, as was told, and so on.</p>",
    ],
)
def test_names_of_sections_and_formulas_stay(part):
    body = "<p>A first paragraph of the article, with commas, and a good number of words to read.</p>"
    page = f'<html><body><nav><a href="/">Home</a></nav><article><h1>Title of it</h1>{body}{part}{body}</article><footer>© us</footer></body></html>'
    text = html_extract.extract(page, [0.0] * html_extract.N_FEATURES)
    assert text.split("\n") == ["Title of it", *[b.text for b in html_extract.blocks_of(body + re.sub("</?section[^>]*>", "", part) + body)]]


def test_a_long_page_is_extracted_whole(spark):
    body = "".join(f"<p>Paragraph {i} of a long article, with commas, and words enough to read it.</p>" for i in range(4000))
    pages = spark.createDataFrame([(1, "u", f"<nav><a>Home</a></nav><article>{body}</article>", 5), (None, None, None, None)], "page_id bigint, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_extract.extract_text(pages, weights=[0.0] * html_extract.N_FEATURES).collect()}
    assert got[1].text.count("\n") == 3999 and got[1].n_chars == len(got[1].text) and (got[None].text, got[None].n_chars) == ("", 0)


# --- training order --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_with_cycle_walking_permutes_every_size(n):
    f = training_order.Feistel(n, "k")
    slots = f.slot(np.arange(n))
    assert sorted(slots) == list(range(n)) and (f.number(slots) == np.arange(n)).all()
    assert n < 64 or not (slots == training_order.Feistel(n, "other").slot(np.arange(n))).all()


def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} " + "with words " * (i % 40)) for i in range(300)] + [(999, None)], "doc_id bigint, text string").repartition(3)
    got = training_order.materialise(docs, tokenizer_path(), capacity=32, per_shard=20, path=f"{tmp_path}/shards").orderBy("slot").collect()
    made = training_order.sequences(docs, tokenizer_path(), 32).orderBy("sequence_id").collect()
    want = training_order.Feistel(len(made)).number(np.arange(len(made)))
    assert [bytes(r.ids) for r in got] == [bytes(made[i].ids) for i in want]
    assert [(r.slot, r.shard, r.byte_offset) for r in got] == [(i, i // 20, i % 20 * 68) for i in range(len(made))]
    later = training_order.read_shards(spark, f"{tmp_path}/shards", 32, per_shard=20, start=47)
    assert [r.slot for r in later.orderBy("slot").collect()] == list(range(47, len(made)))
    data = b"".join(bytes(r.ids) for r in got)
    assert (np.frombuffer(data, dtype="<u2") > 0).sum() == sum((np.frombuffer(x, dtype="<u4") > 0).sum() for x in packing.Encoder(tokenizer_path()).encode([r.text or "" for r in docs.collect()]))


def test_training_order_of_odd_rows(odd, empty):
    assert training_order.materialise(odd, tokenizer_path()).count() > 100
    assert training_order.materialise(empty, tokenizer_path()).count() == 0

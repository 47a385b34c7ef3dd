"""Operators on hand-made rows, for the cases where tables of the test data say little."""

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.operators import evidence as E
from lintmill.operators import findings as O
from lintmill.operators import graph as G
from lintmill.operators import metrics as M
from lintmill.operators.vectors import nearest
from lintmill.operators.order import numbered, numbered_within
from lintmill.plans import sql as Q
from lintmill.plans.queries import QUERIES, classified
from lintmill.sources import sinks as S
from lintmill.sources import text as X
from lintmill.sources.tables import edges, findings_raw, source_lines
from lintmill.streaming.corpus import SCHEMA, event_counts, keep_merged
from tests.helpers import duck_rows, spark_rows


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_dedupe_keeps_the_first_of_three(spark):
    f = rows(spark, [("r", "head", "f", 1, 1, "b", 2), ("r", "head", "f", 1, 1, "a", 1), ("r", "head", "f", 1, 1, "c", 3)], "repo string, side string, fingerprint string, line int, col int, severity string, ord int")
    assert [r.severity for r in O.dedupe(f).collect()] == ["a"]


def test_budget_is_greedy_with_ties_in_input_order(spark):
    f = rows(spark, [("r", "h", x, s, i) for i, (x, s) in enumerate([("a", 5), ("a", 9), ("a", 9), ("b", 5), ("c", 1)])], "repo string, side string, file string, score int, ord int")
    assert sorted(r.ord for r in O.budgeted(f, 1, 2).collect()) == [1, 3]
    assert O.budgeted(f, 0, 0).count() == 5


def test_pack_skips_what_does_not_fit_and_goes_on(spark):
    u = rows(spark, [(1, "a", 0, 10, 6, ""), (1, "b", 1, 9, 6, ""), (1, "c", 2, 8, 3, ""), (2, "d", 0, 1, 99, "")], "grp int, id string, seq int, priority int, tokens int, text string")
    got = E.packed(u, 10)
    assert [(r.grp, r.id) for r in got.orderBy("grp", "place").collect()] == [(1, "a"), (1, "c"), (2, None)]
    assert {r.grp: r.recall for r in E.recall(got, rows(spark, [(1, "a"), (1, "b")], "grp int, id string")).collect()} == {1: 0.5, 2: 1.0}


def test_locks_of_every_access(spark):
    a = rows(spark, [("READS", "f1", ["A", "B", "A"], 1), ("WRITES", "f1", ["B"], 2), ("READS", "f2", [], 3)], "kind string, dst string, locks array<string>, o_orderkey int")
    assert {r.field: (r.accesses, r.has_write, r.locks) for r in G.common_locks(a).collect()} == {"f1": (2, True, "B"), "f2": (1, False, "")}


def test_reachability_stops_at_hops_confidence_and_cycles(spark):
    e = rows(spark, [("CALLS", "a", "b", 0.9), ("CALLS", "b", "c", 0.9), ("CALLS", "c", "a", 0.9), ("CALLS", "a", "d", 0.5), ("READS", "a", "e", 0.9)], "kind string, src string, dst string, confidence double")
    start = rows(spark, [("a",)], "id string")
    assert {(r.id, r.hops) for r in G.reachable(e, start, "CALLS", 5, 0.6).collect()} == {("b", 1), ("c", 2)}
    assert {r.id for r in G.reachable(e, start, "CALLS", 1, 0.6, reverse=True).collect()} == {"c"}


def test_call_graph_without_refinement(spark):
    c = rows(spark, [("a", "b"), ("a", "b")], "src string, dst string")
    assert [(r.producer, r.confidence) for r in G.call_graph(c, c, False).collect()] == [("cha", 0.75)] * 2


def test_diff_counts_a_fingerprint_once(spark):
    base = rows(spark, [("r", "x")], "repo string, fingerprint string")
    head = rows(spark, [("r", "x"), ("r", "y"), ("r", "y")], "repo string, fingerprint string")
    assert O.absent(head, base).count() == 2 and O.absent(base, head).count() == 0


def test_metrics_of_empty_and_single_class(spark):
    schema = "y int, pred int, score double"
    none = M.confusion(rows(spark, [], schema)).first()
    assert none.precision == none.recall == none.f1 == none.fpr == none.accuracy == 0
    assert str(M.auc(rows(spark, [(1, 1, 0.5)], schema)).first().auc) == "nan"
    assert M.auc(rows(spark, [(1, 1, 0.5), (0, 1, 0.5), (1, 1, 0.9)], schema)).first().auc == 0.75
    assert tuple(M.majority(rows(spark, [(1, 1, 0.5), (0, 1, 0.5)], schema)).first()) == (1, 0.5, 0.5)


def test_generated_marker_after_package_does_not_count_for_ranking(spark):
    lines = rows(spark, [(1, 1, "// Code generated by x. DO NOT EDIT."), (2, 1, "package p"), (2, 2, "// Code generated by x. DO NOT EDIT.")], "doc_id int, line_no int, text string")
    assert [r.doc_id for r in O.generated_files(lines).collect()] == [1]


def test_vet_errors_parse_with_their_prefix(spark):
    got = X.parse_vet(rows(spark, [("vet: ./a.go:1:2: bad",), ("./a.go:3: no column",), ("# p",)], "value string")).collect()
    assert [(r.file, r.line, r.col, r.rule) for r in got] == [("vet: ./a.go", 1, 2, "vet.other")]


def test_reports_are_written(spark, sf_dir, tmp_path):
    c = classified(spark, sf_dir)
    kept = O.kept(c).where("repo = 'org__repo1'")
    log = json.loads(S.sarif_log(kept).first().sarif)
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == sorted({r["ruleId"] for r in run["results"]})
    tools = rows(spark, [(1, "go vet"), (2, "semgrep")], "ordinal int, name string")
    text = S.markdown(kept, O.by_human(c), O.tool_runs(findings_raw(spark, sf_dir).where("repo = 'org__repo1'"), tools), 3).first().markdown
    assert "### 3. " in text and "### 4. " not in text and "| semgrep | **no** | 0 | - |" in text
    S.csv_table(O.repo_summary(c, findings_raw(spark, sf_dir)), f"{tmp_path}/summary")
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary").count() == O.repo_summary(c, findings_raw(spark, sf_dir)).count()
    S.json_report(kept, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == kept.count()


def test_snapshot_store(spark, sf_dir, tmp_path):
    store, e = S.SnapshotStore(spark, f"{tmp_path}/snapshots"), edges(spark, sf_dir).limit(20)
    assert not store.has("k") and store.load("k") is None
    store.save(e, "k")
    store.save(e.limit(3), "other")
    store.save(e.limit(5), "k")
    assert store.load("k").count() == 5 and store.load("other").count() == 3


def test_stream_replaces_a_repository(spark, tmp_path):
    at = lambda x: f"{tmp_path}/{x}"
    for k, reported in enumerate((4, 6)):
        rows(spark, [("r1", "t", "a", reported, 2, 1)] + ([("r2", "t", "a", 1, 1, 1)] if k == 0 else []), SCHEMA).write.mode("append").parquet(at("in"))
        keep_merged(spark, at("in"), at("store"), at("merged"), at("check"))
    assert [tuple(r[c] for c in ("reported", "suppressed", "repos", "rate")) for r in spark.read.parquet(at("merged")).collect()] == [(7, 3, 2, 0.3)]


def test_event_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert event_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_lockset_fold_intersects_the_accesses_between_first_and_last(spark):
    rows = [("READS", "field:1", 1, ["L1", "L2"]), ("WRITES", "field:1", 2, ["L2"]), ("READS", "field:1", 3, ["L1", "L2"]), ("READS", "field:2", 4, ["L1"]), ("READS", "field:2", 5, []), ("READS", "field:2", 6, ["L1", "L1"])]
    accesses = spark.createDataFrame(rows, "kind string, dst string, o_orderkey bigint, locks array<string>")
    assert {tuple(r) for r in G.lockset_fold(accesses).collect()} == {("field:1", "L2"), ("field:2", "")}


def test_lockset_fold_equals_sql_over_all_accesses(spark, duck, sf_dir):
    sql = f"WITH {Q.EDGES}, ac AS (SELECT * FROM ed WHERE kind <> 'CALLS') SELECT f.dst AS field, coalesce(string_agg(lock, ',' ORDER BY lock), '') AS locks FROM (SELECT DISTINCT dst FROM ac) f LEFT JOIN (SELECT DISTINCT a.dst, l.lock FROM ac a, unnest(a.locks) l(lock) WHERE NOT EXISTS (SELECT 1 FROM ac o WHERE o.dst = a.dst AND NOT list_contains(o.locks, l.lock))) h ON h.dst = f.dst GROUP BY f.dst"
    assert spark_rows(QUERIES["set03_lockset_fold"](spark, sf_dir)) == duck_rows(duck.sql(sql))


def test_rerank_searches_for_every_twentieth_vector(spark, duck, sf_dir):
    sql = """WITH s AS (SELECT q.vec_id AS qid, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
    SELECT qid, vec_id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS place FROM s QUALIFY place <= 5"""
    got = QUERIES["dsg13_rerank"](spark, sf_dir)
    assert spark_rows(got) == duck_rows(duck.sql(sql))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Broadcast" not in plan


def test_source_lines_are_those_of_all_documents(spark, duck, sf_dir):
    sql = "SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n FROM documents"
    assert spark_rows(source_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))) == duck_rows(duck.sql(sql))


def test_citations_into_any_document_are_grounded(spark, tmp_path):
    spark.createDataFrame([(45, "\n".join(map(str, range(10))))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(45, 1), (45, 3)], "conv_id bigint, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in QUERIES["jon08_ungrounded"](spark, str(tmp_path)).collect()] == [(45, "f45:16")]


def test_markdown_tells_commit_seconds_and_errors(spark):
    found = rows(spark, [], "repo string, side string, score int, file string, line int, ord int, is_test boolean, priority string, rule string, category string, tool string, message string")
    runs = rows(spark, [("r", "head", 0, "go vet", True, 0, 1.5, ""), ("r", "head", 1, "staticcheck", False, 0, 0.25, "not found")], "repo string, side string, ordinal int, name string, ran boolean, findings bigint, seconds double, error string")
    attempts = rows(spark, [("r", "head", "0123456789abcdef")], "repo string, side string, commit string")
    text = S.markdown(found, found, runs, 5, attempts).first().markdown
    assert "| staticcheck | **no**: not found | 0 | 0.25 |" in text and "| go vet | yes | 0 | 1.50 |" in text and " at `0123456789ab`" in text and "No finding to show." in text


def test_corpora_merge(spark, tmp_path):
    negative = "repo string, side string, file string, line int, col int, rule string, message string"
    for k, (repo, status) in enumerate([("b", "ok"), ("a", "error: clone")]):
        summary = rows(spark, [(repo, "head", "c", status, *((5, 4, 0, 1, 1, 0, 0, 1, 1, 2) if status == "ok" else (None,) * 10), 1.5)], S.SUMMARY)
        S.summary_table(summary, f"{tmp_path}/in/{k}/summary")
        frequency = rows(spark, [("t", "x", "C", 4, 1 + k, 0.2, 1)], "tool string, rule string, category string, reported bigint, suppressed bigint, rate double, repos bigint")
        S.frequency_table(frequency, f"{tmp_path}/in/{k}/rule_frequency")
        S.negatives(rows(spark, [(repo, "head", "f", 1, 1, "x", "m")], negative), f"{tmp_path}/in/{k}/negatives")
    S.merge_corpus(spark, f"{tmp_path}/in/*", f"{tmp_path}/out")
    merged = S.read_tables(spark, f"{tmp_path}/out/rule_frequency", S.FREQUENCY).collect()
    assert [tuple(r) for r in merged] == [("t", "x", "C", 8, 3, 0.273, 2)]
    assert [(r.repo, r.raw) for r in S.read_tables(spark, f"{tmp_path}/out/summary", S.SUMMARY).collect()] == [("a", None), ("b", 5)]
    assert [json.loads(r.value)["repo"] for r in spark.read.text(f"{tmp_path}/out/negatives").orderBy("value").collect()] == ["a", "b"]
    assert "1 reports, 1 failed" in spark.read.text(f"{tmp_path}/out/report", wholetext=True).first().value


def test_metric_report(spark, tmp_path):
    S.metric_report(rows(spark, [("b", 0.5, 3), ("a", None, 4)], "model string, auc double, n int"), f"{tmp_path}/metrics")
    assert spark.read.text(f"{tmp_path}/metrics/markdown", wholetext=True).first().value.strip().split("\n")[2:] == ["| a | - | 4 |", "| b | 0.500 | 3 |"]
    assert spark.read.json(f"{tmp_path}/metrics/json").count() == 2


def test_loaders_of_symbols_and_chunks(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"moniker":"m","path":"p","line":1,"col":2,"is_definition":true}\n{"path":"q"}\nnot json\n')
    (tmp_path / "c.json").write_text('{"path":"p","start_line":3,"end_line":5,"kind":"func"}\n{"path":"p","start_line":3,"end_line":1}\n')
    assert [r.moniker for r in X.symbols(spark, f"{tmp_path}/s.json").collect()] == ["m"] and X.chunks(spark, f"{tmp_path}/c.json").count() == 1


def test_places_of_ties_and_one_hot_key(spark):
    data = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), (F.col("id") % 7).alias("v"))
    got = numbered_within(data, ("k",), F.desc("v"))
    want = data.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy(F.desc("v"))).cast("bigint"))
    assert spark_rows(got) == spark_rows(want) and numbered(data.limit(0), "v").count() == 0
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_plan_of_reachability_grows_by_a_scan_per_hop(spark, sf_dir):
    start = rows(spark, [("fn:7",)], "id string")
    sizes = [G.reachable(edges(spark, sf_dir), start, "CALLS", hops, 0.6)._jdf.queryExecution().optimizedPlan().toString().count("Relation") for hops in (1, 2, 3)]
    assert sizes[0] == 2 and all(0 <= b - a <= 1 for a, b in zip(sizes, sizes[1:], strict=False))


def test_gate_globs_and_evidence(spark):
    schema = "repo string, side string, file string, line int, ord int, score int, priority string, rule string, evidence string"
    f = rows(spark, [("r", "h", p, 1, i, 90, "high", "x", e) for i, (p, e) in enumerate([("a/b.go", "static_fact"), ("vendor/a.go", "static_fact"), ("x/vendor/a.go", "static_fact"), ("a/c_generated.go", "reproduced"), ("a.go", "hypothesis")])], schema)
    gates = rows(spark, [("", "high", "static_fact", ["vendor/**", "**/*_generated.go"], [], 9)], "repo string, min_priority string, min_evidence string, exclude array<string>, disabled array<string>, max_comments int")
    assert {r.file for r in O.gated(f, gates).collect()} == {"a/b.go", "x/vendor/a.go"}


def test_nearest_in_blocks_with_ties_and_zero_vectors(spark):
    data = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)] + [(100, [0.0, 0.0, 0.0]), (101, None), (None, [1.0, 1.0, 1.0])]
    v = rows(spark, data, "vec_id bigint, v array<double>").repartition(3)
    norm = lambda x: sum(a * a for a in x) ** 0.5
    want = set()
    for q, x in data[:40:4]:
        ranked = sorted((-round(sum(a * b for a, b in zip(x, y, strict=True)) / norm(x) / norm(y), 6), i) for i, y in data[:40] if i != q)
        want |= {(q, i, -c, p) for p, (c, i) in enumerate(ranked[:3], 1)}
    for block in (1024, 3):
        assert {tuple(r) for r in nearest(v, v.where("vec_id % 4 = 0"), 3, block).collect()} == want
    assert nearest(v.limit(0), v, 3).count() == 0 and nearest(v, v.limit(0), 3).count() == 0

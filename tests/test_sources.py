"""Folders of analyzer output, sketches that merge, and files to index again as a stream."""

import pytest
from pyspark.sql import functions as F

from lintmill.operators import findings as O
from lintmill.sources.datasource import register
from lintmill.sources.folders import findings_of, tool_lines
from lintmill.sources.text import file_lines, inventory, parse_vet, walk
from lintmill.streaming.reindex import changed_files

VET = ["# pkg", "./a.go:3:4: the cancel function is not used", "b_test.go:7:1: Unreachable code", "no place here", "c.go:9: no column", ""]
STATIC = ['{"code":"SA4006","severity":"error","location":{"file":"x.go","line":3,"column":2},"message":"never used"}', '{"code": ', "exit status 1"]


@pytest.fixture
def folder(tmp_path):
    for repo, side in (("org__one", "base"), ("org__one", "head"), ("org two+three", "head")):
        at = tmp_path / "out put" / repo / side
        at.mkdir(parents=True)
        (at / "vet.txt").write_text("\n".join([*VET, f"{repo}.go:1:1: self-assignment of x"]))
        (at / "staticcheck.json").write_text("\n".join(STATIC))
        (at / "other.txt").write_text("a.go:1:1: not a known tool")
    (tmp_path / "out put" / "vet.txt").write_text("a.go:1:1: too high up")
    return f"file://{tmp_path}/out put"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select("repo", "side", "tool", "rule", "file", "line", "col", "message", "fingerprint", "ordinal").collect())


def test_a_folder_gives_the_findings_of_its_files(spark, folder):
    got = findings_of(tool_lines(spark, folder))
    lines = spark.createDataFrame([(r, s, v) for r, s in (("org__one", "base"), ("org__one", "head"), ("org two+three", "head")) for v in [*VET, f"{r}.go:1:1: self-assignment of x"]], "repo string, side string, value string")
    assert rows(got.where("tool = 'go vet'")) == rows(parse_vet(lines).withColumn("ordinal", F.lit(0)))
    assert got.where("tool = 'staticcheck'").count() == 3 and {r.ordinal for r in got.collect()} == {0, 1}


def test_a_stream_of_the_folder_gives_the_same_and_goes_on_after_a_restart(spark, folder, tmp_path):
    def run():
        stream = findings_of(tool_lines(spark, folder, stream=True))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "sink")))

    assert run() == rows(findings_of(tool_lines(spark, folder)))
    at = tmp_path / "out put" / "new" / "base"
    at.mkdir(parents=True)
    (at / "vet.txt").write_text("z.go:1:1: Unreachable code")
    assert run() == rows(findings_of(tool_lines(spark, folder))) and len(run()) == 3 * 4 + 1


def test_the_folder_reads_lines_alone_for_a_count(spark, folder):
    plan = findings_of(tool_lines(spark, folder)).groupBy("repo").count()._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan  # fingerprints are not made


def test_a_walk_gives_the_inventory_of_a_folder(spark, tmp_path):
    for name, text in (("main.go", "package main\n\nfunc main() {}\n"), ("pkg/gen.go", "// Code generated by x. DO NOT EDIT.\npackage pkg\n"), ("vendor/v/v_test.go", "package v"), (".git/hook.py", "x"), ("web/node_modules/a.ts", "x"), ("Dockerfile", ""), ("notes.unknown", "x")):
        at = tmp_path / "r" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    got = {r.path: (r.language, r.lines, r.bytes, r.is_test, r.is_vendored, r.is_generated) for r in inventory(walk(spark, str(tmp_path / "r"))).collect()}
    assert got == {"main.go": ("Go", 3, 29, False, False, False), "pkg/gen.go": ("Go", 2, 49, False, False, True), "vendor/v/v_test.go": ("Go", 1, 9, True, True, False), "Dockerfile": ("Dockerfile", 0, 0, False, False, False)}


def found(spark, repos, n, reason=""):
    rows = spark.range(n).select(F.concat(F.lit("r"), (F.col("id") % repos).cast("string")).alias("repo"), F.lit("head").alias("side"), F.col("id").cast("string").alias("fingerprint"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit("t").alias("tool"), F.lit("x").alias("rule"))
    return rows.withColumn("suppress_reason", F.lit(reason))


def test_sketches_merge_more_than_once_without_a_change(spark):
    rows = found(spark, 3000, 40_000).union(found(spark, 500, 800, "nolint")).union(found(spark, 10, 50, "vendored"))
    one, two = O.rule_sketches(rows.where("cast(fingerprint as int) < 25000")), O.rule_sketches(rows.where("cast(fingerprint as int) >= 15000 or suppress_reason <> ''"))
    once = O.merged_sketches(one.union(two))
    twice = O.merged_sketches(once.union(one).union(two).union(once))
    told = lambda df: O.sketch_estimates(df).first()
    assert told(once) == told(twice)
    got = told(once)
    for estimate, true in ((got.repos, 3000), (got.reported, 40_000), (got.suppressed, 800)):
        assert abs(estimate - true) <= 4 / 64 * true
    assert (got.repos, got.suppressed) == (3000, 800)  # counts up to 4,096 are exact
    assert O.exact_members(rows).count() == 3000


def test_changed_files_as_a_stream_equal_the_batches_sum_and_survive_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "id string, seq bigint, text string"
    batches = [
        [("a", 1, "one"), ("b", 1, "two"), ("c", 1, "three"), ("a", 0, "older"), ("d", 1, None)],
        [("a", 2, "one"), ("b", 2, "two!"), ("c", 2, None), ("e", 2, "new")],
        [("c", 3, "back"), ("b", 3, "two!!"), ("b", 4, "two!"), ("e", 3, None), ("z", 1, "late")],
    ]
    want = [{("a", "new"), ("b", "new"), ("c", "new")}, {("b", "changed"), ("c", "removed"), ("e", "new")}, {("c", "new"), ("e", "removed"), ("z", "new")}]
    out = []

    def run():  # each run is a new query on the same checkpoint, as after a restart
        changes = changed_files(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        changes.writeStream.foreachBatch(lambda df, _: out.append({(r.id, r.state) for r in df.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        run()
        assert out[-1] == want[i]
    assert len(out) == 3


def test_lines_of_files(spark):
    texts = ["a\r\nb\r\r\n\nc", "a\n", "", "\n", None, "x\n" + "é" * 6 + "\ny", "é" * 5, "\r", "a\rb\n\n"]
    got = {}
    for r in file_lines(spark.createDataFrame(list(enumerate(texts)), "path int, text string"), max_line_bytes=10).orderBy("path", "line_no").collect():
        got.setdefault(r.path, []).append((r.line_no, r.text))
    want = {0: ["a", "b\r", "", "c"], 1: ["a"], 3: [""], 5: ["x"], 6: ["é" * 5], 7: [""], 8: ["a\rb", ""]}
    assert got == {i: list(enumerate(x, 1)) for i, x in want.items()}


def test_states_of_findings_over_snapshots(spark):
    import datetime

    day = lambda y: datetime.date(y, 5, 1)
    rows = [("r", "f", day(y), reason) for y, reason in ((2001, ""), (2002, ""), (2003, "nolint"), (2004, ""), (2006, ""), (2006, "vendored"))] + [("r", "g", day(2008), "")]
    got = {(x.fingerprint, x.snapshot, x.state) for x in O.lifecycle_states(spark.createDataFrame(rows, "repo string, fingerprint string, seen date, suppress_reason string")).collect()}
    assert got == {("f", 2001, "introduced"), ("f", 2002, "persisted"), ("f", 2003, "suppressed"), ("f", 2004, "reported_again"), ("f", 2005, "fixed"), ("f", 2006, "introduced"), ("f", 2007, "fixed"), ("g", 2008, "introduced")}


def test_the_data_source_gives_the_lines_of_a_folder_with_their_numbers(spark, folder):
    register(spark)
    lines = spark.read.format("analyzer_output").load(folder)
    assert lines.rdd.getNumPartitions() == 9
    got = sorted((r.repo, r.side, r.line_no, r.value) for r in lines.where("source = 'vet'").collect())
    assert got == sorted((r, s, n, v) for r, s in (("org__one", "base"), ("org__one", "head"), ("org two+three", "head")) for n, v in enumerate([*VET, f"{r}.go:1:1: self-assignment of x"], 1))
    assert rows(findings_of(lines.drop("path", "line_no"))) == rows(findings_of(tool_lines(spark, folder)))
    first = findings_of(lines).withColumns({"ord": F.struct("path", "line_no")})
    assert O.dedupe(first).count() == first.count()
    assert sorted(map(tuple, spark.read.format("analyzer_output").schema("side string, line_no bigint").load(folder).distinct().collect()))[:2] == [("base", 1), ("base", 2)]


def test_the_data_source_as_a_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    register(spark)

    def run():
        stream = findings_of(spark.readStream.format("analyzer_output").load(folder).drop("path", "line_no"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "sink")))

    assert run() == rows(findings_of(tool_lines(spark, folder)))
    at = tmp_path / "out put" / "new" / "base"
    at.mkdir(parents=True)
    (at / "vet.txt").write_text("z.go:1:1: Unreachable code")
    assert run() == rows(findings_of(tool_lines(spark, folder))) and len(run()) == 3 * 4 + 1


def test_long_files_come_in_batches_and_packed_ones_are_unpacked(spark, tmp_path):
    import gzip

    register(spark)
    at = tmp_path / "r" / "repo" / "head"
    at.mkdir(parents=True)
    many = [f"a.go:{i}:1: Unreachable code" for i in range(1, 30_001)]
    (at / "vet.txt.gz").write_bytes(gzip.compress("\n".join(many).encode()))
    (at / "staticcheck.json").write_text("")
    got = spark.read.format("analyzer_output").load(str(tmp_path / "r")).orderBy("line_no").collect()
    assert [r.value for r in got] == many and [r.line_no for r in got] == list(range(1, 30_001))

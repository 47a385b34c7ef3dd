"""Writers of reports, and the snapshot store. Every one goes through Spark's own writers and their commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.operators import findings as O

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def json_report(findings: DataFrame, path: str) -> None:
    """One JSON object per finding, partitioned by report."""
    findings.drop("ord").write.mode("overwrite").partitionBy(*O.KEYS).json(path)


def csv_table(rows: DataFrame, path: str) -> None:
    """A statistics table (repository summary, rule frequency) with a header, in one file: such tables have a row per repository or rule."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def sarif_log(findings: DataFrame) -> DataFrame:
    """(repo, side, sarif): one SARIF 2.1.0 log per report. A log is one document by its format, so a report's results meet in one row;
    for large reports use ``operators.findings.sarif_results``, a row per result."""
    results = O.sarif_results(findings).groupBy(*O.KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "result"))), lambda x: x["result"]), ",").alias("results"))
    rule = F.to_json(F.struct(F.col("rule").alias("id"), F.struct(F.col("rule").alias("text")).alias("shortDescription"), F.struct("category", F.array("tool").alias("tags")).alias("properties")))
    rules = O.sarif_rules(findings).groupBy(*O.KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", rule.alias("r")))), lambda x: x["r"]), ",").alias("rules"))
    head, driver = '{"$schema":"' + SARIF_SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":{"name":"lintmill","rules":[', ']}},"results":['
    return results.join(rules, list(O.KEYS)).select(*O.KEYS, F.concat(F.lit(head), "rules", F.lit(driver), "results", F.lit("]}]}")).alias("sarif"))


def summary_table(summary: DataFrame, path: str) -> None:
    """The rows of ``attempt_summary`` as CSV by repository and side; a failed report has blanks for its counts."""
    csv_table(summary.orderBy("repo", "side"), path)


def frequency_table(frequency: DataFrame, path: str) -> None:
    """Rule statistics as CSV, the most frequent first, rates with three decimals."""
    total = F.col("reported") + F.col("suppressed")
    rate = F.format_string("%.3f", F.coalesce("rate", F.lit(0.0)))
    rows = frequency.orderBy(F.desc(total), "rule", "tool").select("tool", "rule", "category", "reported", F.col("suppressed").alias("suppressed_by_human"), rate.alias("suppression_rate"), "repos")
    csv_table(rows, path)


def negatives(rows: DataFrame, path: str) -> None:
    """Hard negatives as JSON lines, repositories in order of their names: files and the rows in them are range-partitioned by it."""
    jsonl(rows.repartitionByRange("repo", "side", "file", "line").sortWithinPartitions("repo", "side", "file", "line", "col", "rule", "message"), path)


FREQUENCY = "tool string, rule string, category string, reported bigint, suppressed_by_human bigint, suppression_rate double, repos bigint"
SUMMARY = "repo string, side string, commit string, status string, raw bigint, reported bigint, suppressed_structural bigint, suppressed_by_comment bigint, negatives bigint, in_tests bigint, critical bigint, high bigint, medium bigint, low bigint, seconds double"


def read_tables(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """CSV tables of earlier runs with a header, by an explicit schema; ``paths`` may be globs."""
    return spark.read.schema(schema).option("header", True).csv(paths)


def merge_corpus(spark: SparkSession, paths: str, out: str, limit: int = 25) -> None:
    """One corpus from the folders summary, rule_frequency and negatives under each of ``paths`` (a glob): the tables merged under ``out``, and a report."""
    frequency = read_tables(spark, f"{paths}/rule_frequency", FREQUENCY).withColumnRenamed("suppressed_by_human", "suppressed")
    categories = frequency.groupBy("tool", "rule").agg(F.min("category").alias("category"))
    merged = O.merged_frequency(frequency).join(categories, ["tool", "rule"])
    frequency_table(merged, f"{out}/rule_frequency")
    summary = read_tables(spark, f"{paths}/summary", SUMMARY)
    summary_table(summary, f"{out}/summary")
    found = spark.read.text(f"{paths}/negatives")  # records stay as they are
    found.repartitionByRange(F.get_json_object("value", "$.repo"), F.get_json_object("value", "$.file")).write.mode("overwrite").text(f"{out}/negatives")
    totals = O.corpus_totals(summary).first()
    top = merged.orderBy(F.desc(F.col("reported") + F.col("suppressed")), "rule", "tool").limit(limit).collect()  # ``limit`` rows
    lines = ["# Corpus", "", f"{totals.ok} reports, {totals.failed} failed", "", "| # | rule | tool | reported | dismissed | rate |", "| --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {i} | {r.rule} | {r.tool} | {r.reported} | {r.suppressed} | {r.rate:.3f} |" for i, r in enumerate(top, 1)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")


def metric_report(metrics: DataFrame, path: str) -> None:
    """Metrics of a few models, a row each with its name first, as JSON lines and as a Markdown table."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.3f", c) if kind == "double" else F.col(c).cast("string")) for c, kind in metrics.dtypes]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("-")) for c in shown]), F.lit(" |"))
    head = "\n".join(["| " + " | ".join(metrics.columns) + " |", "| " + " | ".join("---" for _ in metrics.columns) + " |"])
    name = metrics.columns[0]
    table = metrics.agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), row.alias("r")))), lambda x: x["r"]), "\n")).alias("value"))
    table.write.mode("overwrite").text(f"{path}/markdown")


def markdown(findings: DataFrame, suppressed: DataFrame, runs: DataFrame, limit: int, attempts: DataFrame | None = None) -> DataFrame:
    """(repo, side, markdown): commit, tools with seconds and errors, counts and the ``limit`` highest findings of each report; 0 or less means all.

    runs: as ``timed_runs`` or ``tool_runs`` give them; attempts: (repo, side, commit), if known.
    """
    keys = list(O.KEYS)
    seconds = F.format_string("%.2f", "seconds") if "seconds" in runs.columns else F.lit("-")
    why = F.when(F.col("error") != "", F.concat(F.lit(": "), "error")).otherwise("") if "error" in runs.columns else F.lit("")
    ran = F.when(F.col("ran"), "yes").otherwise(F.concat(F.lit("**no**"), why))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "name", ran, F.col("findings").cast("string"), seconds), F.lit(" |"))
    tools = runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"]), "\n").alias("tools"))
    names = ("critical", "high", "medium", "low")
    counts = findings.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("is_test").alias("tests"), *[F.count_if(F.col("priority") == p).alias(p) for p in names])
    hidden = suppressed.groupBy(*keys).agg(F.count("*").alias("hidden"))
    top = O.ranked(findings, limit)
    mark = F.when(F.col("is_test"), ", in a test").otherwise("")
    item = F.concat(
        F.format_string("### %d. `%s`: %s", "rank", "rule", "priority"), mark, F.lit("\n\n"), F.format_string("`%s:%d`, %s, %d points, found by %s", "file", "line", "category", "score", "tool"), F.lit("\n\n"), "message"
    )
    items = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("i")))), lambda x: x["i"]), "\n\n").alias("items"))
    out = tools.join(counts, keys, "left").join(hidden, keys, "left").join(items, keys, "left")
    commit = F.lit("")
    if attempts is not None:
        out = out.join(attempts.select(*keys, "commit"), keys, "left")
        commit = F.when(F.coalesce("commit", F.lit("")) != "", F.concat(F.lit(" at `"), F.substring("commit", 1, 12), F.lit("`"))).otherwise("")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = F.concat(*[F.when(zero(p) > 0, F.concat(F.lit(f"- {p}: "), F.col(p).cast("string"), F.lit("\n"))).otherwise("") for p in names])
    body = F.when(F.col("items").isNull(), "\nNo finding to show.\n").otherwise(F.concat(F.lit("\n## Candidates\n\n"), "items", F.lit("\n\n---\n\nNothing here has been run; judge each candidate in its code.\n")))
    text = F.concat(
        F.format_string("# Findings of `%s`", "repo"), commit, F.lit("\n\n## Analyzers\n\n| Name | Ran | Found | Seconds |\n| --- | --- | --- | --- |\n"), "tools",
        F.format_string("\n\n## Counts\n\n- shown: **%d**, of which in tests: %d\n- hidden: %d\n", zero("n"), zero("tests"), zero("hidden")), each, body,
    )
    return out.select(*keys, text.alias("markdown"))


class SnapshotStore:
    """Graphs by snapshot key: a partition per key, overwritten as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, edges: DataFrame, key: str) -> None:
        rows = edges.withColumn("snapshot_key", F.lit(key))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_key").parquet(self.path)

    def has(self, key: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshot_key={key}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def load(self, key: str) -> DataFrame | None:
        """The edges of a snapshot, or nothing."""
        return self.spark.read.parquet(self.path).where(F.col("snapshot_key") == key).drop("snapshot_key") if self.has(key) else None

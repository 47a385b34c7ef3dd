"""Operators on findings: dedupe, classify, suppress, score, rank, budget, cluster, diff, statistics and hard negatives.

Rows come in no order, so ``ord`` holds each report's input order, and ``keys`` names the columns that make up one report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.functions import rules as R
from lintmill.operators.order import numbered_within
from lintmill.sources.text import MARKER

KEYS = ("repo", "side")
HEAD_LINES, MARKER_LINES, RADIUS = 50, 20, 6
#: Tables of gates up to this many repositories are broadcast.
BROADCAST_GATES = 10_000


def dedupe(findings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The first row of each fingerprint, line and column in a report."""
    place = W.partitionBy(*keys, "fingerprint", "line", "col").orderBy("ord")
    return findings.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


_IDENTITY = ("tool", "rule", "file", "message", "line", "col")


def with_order(few: DataFrame, findings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``few`` findings with ``ord``, the first that ``findings`` (raw ones) have of each; the few are sent to every task, so that no raw finding is shuffled."""
    same = [*keys, *_IDENTITY]
    return findings.select(*same, "ord").join(F.broadcast(few), same).groupBy(*few.columns).agg(F.min("ord").alias("ord"))


def generated_files(lines: DataFrame) -> DataFrame:
    """doc_id of the files whose marker comes in the first lines and before any package clause."""
    return _file_facts(lines).where("generated").select("doc_id", "generated")


def _file_facts(lines: DataFrame) -> DataFrame:
    """What the first lines say of whole files: generated, and __file, the rules that comments suppress (null: none). Files without either have no row."""
    n, text = F.col("line_no"), F.trim(F.col("text"), F.lit(" \t\r\n"))
    early = n <= MARKER_LINES
    flags = {"marker": early & text.rlike(MARKER), "package": early & text.startswith("package "), "told": F.col("text").rlike(R.FILE_IGNORE)}
    head = lines.where(n <= HEAD_LINES).select("doc_id", "line_no", "text", *(c.alias(name) for name, c in flags.items())).where("marker or package or told")
    first = lambda c: F.min(F.when(F.col(c), n))
    entry = F.when(F.col("told"), F.struct(n.alias("__n"), F.regexp_extract("text", R.FILE_IGNORE, 1).alias("__rules")))
    facts = head.groupBy("doc_id").agg(first("marker").alias("m"), first("package").alias("p"), F.array_sort(F.collect_list(entry)).alias("__file"))  # at most HEAD_LINES entries
    generated = F.coalesce(F.col("m") < F.coalesce("p", F.lit(MARKER_LINES + 1)), F.lit(False))
    out = facts.select("doc_id", generated.alias("generated"), F.when(F.size("__file") > 0, F.col("__file")).alias("__file"))
    return out.where("generated or __file is not null")


def suppressions(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """``findings`` with is_generated, and the comment that suppresses each one (directive, empty if none).

    Lines are joined first, where ``findings`` lie by doc_id and line; what holds for whole files is one more join.
    Only comments are joined, as the patterns match them: what stands before and after them in a line suppresses nothing.
    """
    nolint, ignored = F.regexp_extract("text", R.NOLINT, 0), F.regexp_extract("text", R.LINT_IGNORE, 0)
    told = lambda comment, at, name: lines.select("doc_id", at.alias("line"), comment.alias(name)).where(F.col(name) != "")
    here, above = told(nolint, F.col("line_no"), "__here"), told(F.concat(nolint, ignored), F.col("line_no") + 1, "__above")
    joined = findings.join(here, ["doc_id", "line"], "left").join(above, ["doc_id", "line"], "left")
    rule, tool = F.col("rule"), F.col("tool")
    listed = F.regexp_extract("__above", R.LINT_IGNORE, 1)
    ignore = F.when(F.col("__above").rlike(R.LINT_IGNORE) & R.rule_listed(listed, rule), F.concat(F.lit("lint:ignore "), F.trim(listed)))
    some = lambda c: F.nullif(c, F.lit(""))
    by_line = F.coalesce(some(R.nolint(F.col("__here"), tool, rule)), some(R.nolint(F.col("__above"), tool, rule)), ignore)
    joined = joined.withColumn("__line", by_line).drop("__here", "__above").join(_file_facts(lines), "doc_id", "left")
    hit = F.get(F.filter("__file", lambda x: R.rule_listed(x["__rules"], rule)), 0)["__rules"]
    directive = F.coalesce(F.concat(F.lit("lint:file-ignore "), F.trim(hit)), F.col("__line"), F.lit(""))
    out = joined.withColumns({"directive": F.when(F.col("line") < 1, "").otherwise(directive), "is_generated": F.coalesce("generated", F.lit(False))})
    return out.drop("__file", "__line", "generated")


def classified(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """``findings`` with flags, prior, score, priority and suppress_reason (empty: kept)."""
    flagged = suppressions(findings.withColumns({"is_test": R.is_test(F.col("file")), "is_vendored": R.is_vendored(F.col("file"))}), lines)
    reason = F.when(F.col("is_vendored"), "vendored").when(F.col("is_generated"), "generated").otherwise(F.col("directive"))
    out = flagged.withColumns({"prior": R.rule_prior(F.col("rule")), "suppress_reason": reason})
    out = out.withColumn("score", R.score(F.col("prior"), F.col("is_vendored"), F.col("is_generated"), F.col("is_test")))
    return out.withColumn("priority", R.priority(F.col("score"))).drop("directive")


def kept(findings: DataFrame) -> DataFrame:
    return findings.where("suppress_reason = ''")


def by_human(findings: DataFrame) -> DataFrame:
    """Findings that a comment suppresses, not the kind of file."""
    return findings.where("suppress_reason not in ('', 'vendored', 'generated')")


def ranked(findings: DataFrame, limit: int = 0, keys: tuple[str, ...] = KEYS, ties: bool = False) -> DataFrame:
    """``findings`` with their place in the report: score, then file, line and input order; only the first ``limit``, 0 or less means all.

    A limit is applied before the shuffle; without one, places come from a distributed sort, so that no task holds a whole report.
    With ``ties`` and a limit the input order is not asked for, and all that could be among the first in some order are left.
    """
    if ties and limit > 0:
        place = F.rank().over(W.partitionBy(*keys).orderBy(F.desc("score"), "file", "line"))
        return findings.withColumn("rank", place).where(F.col("rank") <= limit)
    order = (F.desc("score"), "file", "line", "ord")
    if limit <= 0:
        return numbered_within(findings, keys, *order, name="rank").withColumn("rank", F.col("rank").cast("int"))
    return findings.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def glob_pattern(glob: Column) -> Column:
    """The regular expression of a path glob: ** any folders, * and ? within one name."""
    quoted = F.regexp_replace(glob, "([.+(){}|^$\\[\\]\\\\])", "\\\\$1")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, "\\*\\*/", "\u0001"), "\\*\\*", "\u0002"), "\\*", "[^/]*")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(marked, F.lit("?"), F.lit("[^/]")), F.lit("\u0001"), F.lit("(.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("$"))


def gated(findings: DataFrame, gates: DataFrame, keys: tuple[str, ...] = KEYS, ties: bool = False) -> DataFrame:
    """What each report may show by the gate of its repository, or by that of the empty name: findings of enough priority and evidence in files
    and of rules that are not excluded, the highest ``max_comments`` of them. ``gates`` has a row per repository that names its own.
    With ``ties`` the input order is not asked for, as in ``ranked``."""
    default = F.broadcast(gates.where("repo = ''").limit(1).drop("repo").select(*[F.col(c).alias(f"__d_{c}") for c in gates.columns if c != "repo"]))
    own = gates.where("repo <> ''").select("repo", *[F.col(c).alias(f"__g_{c}") for c in gates.columns if c != "repo"], F.lit(True).alias("__own"))
    about = gates.agg(F.max("max_comments").alias("most"), F.count("*").alias("n")).first()
    rows = findings.join(F.broadcast(own) if about["n"] <= BROADCAST_GATES else own, "repo", "left").join(default)
    rule = lambda c: F.when(F.col("__own"), F.col(f"__g_{c}")).otherwise(F.col(f"__d_{c}"))
    shown = (
        (R.priority_rank(F.col("priority")) >= R.priority_rank(rule("min_priority")))
        & (R.evidence_rank(F.col("evidence")) >= R.evidence_rank(rule("min_evidence")))
        & ~F.exists(rule("exclude"), lambda g: F.rlike(F.col("file"), glob_pattern(g)))
        & ~F.array_contains(rule("disabled"), F.col("rule"))
    )
    rows = rows.where(shown).withColumn("__most", rule("max_comments"))
    place = F.rank().over(W.partitionBy(*keys).orderBy(F.desc("score"), "file", "line")) if ties else F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "file", "line", "ord"))
    # the largest limit is a number in the plan, so that Spark limits every report before the shuffle
    return rows.withColumn("rank", place).where(F.col("rank") <= int(about["most"] or 0)).where(F.col("rank") <= F.col("__most")).select(*findings.columns, "rank")


def min_priority(findings: DataFrame, floor: str) -> DataFrame:
    return findings.where(R.priority_rank(F.col("priority")) >= R.priority_rank(F.lit(floor)))


def budgeted(findings: DataFrame, per_file: int, total: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """At most ``per_file`` findings of a file and ``total`` of a report, by score and input order; a cap of 0 or less is off."""
    order = (F.desc("score"), "ord")
    out = findings.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "file").orderBy(*order)))
    out = out.where(F.col("__n") <= per_file) if per_file > 0 else out
    out = out.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return (out.where(F.col("place") <= total) if total > 0 else out).drop("__n")


def clusters(findings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Findings of one rule in one file: category of the first, top score, members in input order, and the place among the report's clusters.

    A cluster's members are those of one rule in one file, so a row stays within what a file can hold.
    """
    member = F.struct("ord", F.struct("tool", "line", "col", "score", "message", "fingerprint").alias("f"))
    out = findings.groupBy(*keys, "rule", "file").agg(
        F.max("score").alias("top_score"), F.min_by("category", "ord").alias("category"), F.count("*").alias("n"), F.min("line").alias("first_line"), F.array_sort(F.collect_list(member)).alias("__m")
    )
    out = out.withColumns({"key": F.concat_ws("|", "rule", "file"), "members": F.transform("__m", lambda x: x["f"])}).drop("__m")
    return numbered_within(out, keys, F.desc("top_score"), "key").withColumn("place", F.col("place").cast("int"))


def absent(rows: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Rows whose fingerprint the other report of the repository lacks; duplicates stay."""
    return rows.join(other.select(*keys, "fingerprint").distinct(), [*keys, "fingerprint"], "left_anti")


def rule_frequency(findings: DataFrame) -> DataFrame:
    """Per tool and rule: reported and human-suppressed findings, their rate, repositories, first category.

    Without ``ord`` a tool's rule has one category. Then findings are counted by repository first, in hash tables, and none are sorted.
    """
    human = ~F.col("suppress_reason").isin("", "vendored", "generated")
    counted = findings.where((F.col("suppress_reason") == "") | human)
    counts = [F.count_if(F.col("suppress_reason") == "").alias("reported"), F.count_if(human).alias("suppressed")]
    if "ord" in findings.columns:
        out = counted.groupBy("tool", "rule").agg(*counts, F.count_distinct("repo").alias("repos"), F.min_by("category", F.struct("repo", "side", "ord")).alias("category"))
    else:
        each = counted.groupBy("tool", "rule", "category", "repo").agg(*counts)
        out = each.groupBy("tool", "rule").agg(F.sum("reported").alias("reported"), F.sum("suppressed").alias("suppressed"), F.count("repo").alias("repos"), F.min("category").alias("category"))
    return out.withColumn("rate", R.rounded(F.col("suppressed") / (F.col("reported") + F.col("suppressed")), 3))


def merged_frequency(per_repo: DataFrame) -> DataFrame:
    """One table from per-repository ones (tool, rule, reported, suppressed, repos)."""
    out = per_repo.groupBy("tool", "rule").agg(F.sum("reported").alias("reported"), F.sum("suppressed").alias("suppressed"), F.sum("repos").alias("repos"))
    total = F.col("reported") + F.col("suppressed")
    return out.withColumn("rate", F.when(total == 0, 0.0).otherwise(R.rounded(F.col("suppressed") / total, 3)))


def succeeded(rows: DataFrame, attempts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of reports that did not fail (FLT07): a failed repository counts in no statistic."""
    return rows.join(attempts.where("error is not null").select(*keys).distinct(), list(keys), "left_anti")


def attempt_summary(findings: DataFrame, raw: DataFrame, attempts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row per attempted report (repo, side, commit, seconds, error; null: none): a failed one has its error as status and no counts, a clean one zeros."""
    counted = repo_summary(findings, raw, keys).withColumn("negatives", F.col("suppressed_by_comment"))
    names = ("raw", "reported", "suppressed_structural", "suppressed_by_comment", "negatives", "in_tests", "critical", "high", "medium", "low")
    out = attempts.join(counted, list(keys), "left")
    ok = F.col("error").isNull()
    numbers = [F.when(ok, F.coalesce(n, F.lit(0))).alias(n) for n in names]
    commit = F.when(ok, R.short_commit(F.col("commit"))).otherwise("").alias("commit")
    return out.select(*keys, commit, F.when(ok, "ok").otherwise(F.concat(F.lit("error: "), "error")).alias("status"), *numbers, R.rounded(F.col("seconds"), 1).alias("seconds"))


def corpus_totals(summary: DataFrame) -> DataFrame:
    """Reports that succeeded and that failed, and what the former hold."""
    ok = F.col("status") == "ok"
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    hidden = F.col("suppressed_structural") + F.col("suppressed_by_comment")
    return summary.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), zero("reported").alias("reported"), zero(hidden).alias("suppressed"), zero("negatives").alias("negatives"))


def repo_summary(findings: DataFrame, raw: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per report: raw findings before dedupe, reported, suppressed by structure and by comment, in tests, and by priority."""
    keep = F.col("suppress_reason") == ""
    human = ~F.col("suppress_reason").isin("", "vendored", "generated")
    counts = [F.count_if(keep & (F.col("priority") == p)).alias(p) for p in ("critical", "high", "medium", "low")]
    done = findings.groupBy(*keys).agg(
        F.count_if(keep).alias("reported"), F.count_if(~keep & ~human).alias("suppressed_structural"), F.count_if(human).alias("suppressed_by_comment"), F.count_if(keep & F.col("is_test")).alias("in_tests"), *counts
    )
    return raw.groupBy(*keys).agg(F.count("*").alias("raw")).join(done, list(keys), "left")


def tool_runs(raw: DataFrame, tools: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per report and registered tool: whether it ran, and its raw findings; a tool without output did not run."""
    reports = raw.select(*keys).distinct()
    counts = raw.groupBy(*keys, F.col("tool").alias("name")).agg(F.count("*").alias("findings"))
    registered = F.array(*[F.struct(F.lit(r["ordinal"]).alias("ordinal"), F.lit(r["name"]).alias("name")) for r in tools.collect()])  # the registry has a few rows
    every = reports.select(*keys, F.explode(registered).alias("t")).select(*keys, "t.*")
    out = every.join(counts, [*keys, "name"], "left")
    return out.select(*keys, "ordinal", "name", F.col("findings").isNotNull().alias("ran"), F.coalesce("findings", F.lit(0)).alias("findings"))


def timed_runs(raw: DataFrame, runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per report and tool that was started (name, ordinal, seconds, error): whether it ran, its raw findings, seconds and error.

    A tool that failed has no findings, whatever it printed before.
    """
    counts = raw.groupBy(*keys, F.col("tool").alias("name")).agg(F.count("*").alias("findings"))
    ran = F.col("error").isNull()
    out = runs.join(counts, [*keys, "name"], "left")
    return out.select(*keys, "ordinal", "name", ran.alias("ran"), F.when(ran, F.coalesce("findings", F.lit(0))).otherwise(0).alias("findings"), R.rounded(F.col("seconds"), 2).alias("seconds"), F.coalesce("error", F.lit("")).alias("error"))


def hard_negatives(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Labelled records of human-suppressed findings: directive, rationale after it, and the lines around.

    The snippet is an equi-join on 13 generated line numbers, not a range join.
    """
    rows = by_human(findings).select("repo", "side", "tool", "rule", "category", "file", "doc_id", "line", "col", "message", F.col("suppress_reason").alias("directive"), "ord")
    near = F.sequence(F.greatest(F.col("line") - RADIUS, F.lit(1)), F.greatest(F.col("line") + RADIUS, F.lit(1)))
    spots = rows.select("doc_id", "line").distinct().withColumn("line_no", F.explode(near))
    found = spots.join(lines, ["doc_id", "line_no"]).groupBy("doc_id", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("snippet"),  # at most 13 lines
        F.max(F.when(F.col("line_no") == F.col("line"), F.col("text"))).alias("here"),
        F.max(F.when(F.col("line_no") == F.col("line") - 1, F.col("text"))).alias("above"),
    )

    def told(text):
        directive = F.when(text.rlike(R.NOLINT), R.NOLINT).when(text.rlike(R.LINT_IGNORE), R.LINT_IGNORE)
        after = F.when(directive == R.NOLINT, F.regexp_extract(text, R.NOLINT + "([\\s\\S]*)$", 2)).when(directive == R.LINT_IGNORE, F.regexp_extract(text, R.LINT_IGNORE + "([\\s\\S]*)$", 2))
        rest = F.when(after.contains("//"), F.regexp_extract(after, "//([\\s\\S]*)$", 1)).otherwise(after)
        return F.nullif(F.trim(rest), F.lit(""))

    out = rows.join(found, ["doc_id", "line"], "left")
    rationale = F.coalesce(told(F.col("here")), told(F.col("above")), F.lit(""))
    return out.select(F.lit("NOT_A_BUG").alias("label"), F.lit("maintainer_suppression").alias("source"), *[c for c in rows.columns if c not in ("doc_id", "ord")], rationale.alias("rationale"), F.coalesce("snippet", F.lit("")).alias("snippet"))


def lifecycle(findings: DataFrame) -> DataFrame:
    """Per repository, fingerprint and snapshot: introduced, persisted, and whether it is fixed in the next one (our own definition)."""
    seen = findings.select("repo", "fingerprint", F.year("seen").alias("snapshot")).distinct()
    w = W.partitionBy("repo", "fingerprint").orderBy("snapshot")
    last = findings.groupBy("repo").agg(F.max(F.year("seen")).alias("last"))
    out = seen.withColumns({"before": F.lag("snapshot").over(w), "after": F.lead("snapshot").over(w)}).join(last, "repo")
    state = F.when(F.col("before") == F.col("snapshot") - 1, "persisted").otherwise("introduced")
    fixed = (F.col("snapshot") < F.col("last")) & (F.coalesce("after", F.lit(0)) != F.col("snapshot") + 1)
    return out.select("repo", "fingerprint", "snapshot", state.alias("state"), fixed.alias("fixed_next"))


def lifecycle_states(findings: DataFrame) -> DataFrame:
    """(repo, fingerprint, snapshot, state) of classified findings with the day they were ``seen``, snapshots being years (our own definition).

    suppressed: there, but every place of it is suppressed. introduced: not in the snapshot before. reported_again: suppressed in the one before.
    persisted: reported in the one before. fixed: not there, but in the one before; what is gone after a repository's last snapshot is not known to be fixed.
    """
    seen = findings.groupBy("repo", "fingerprint", F.year("seen").alias("snapshot")).agg(F.bool_and(F.col("suppress_reason") != "").alias("hidden"))
    w = W.partitionBy("repo", "fingerprint").orderBy("snapshot")
    last = findings.groupBy("repo").agg(F.max(F.year("seen")).alias("last"))
    at = F.col("snapshot")
    out = seen.withColumns({"before": F.lag("snapshot").over(w), "was_hidden": F.lag("hidden").over(w), "after": F.lead("snapshot").over(w)}).join(last, "repo")
    follows = F.coalesce(F.col("before") == at - 1, F.lit(False))
    state = F.when(F.col("hidden"), "suppressed").when(~follows, "introduced").when(F.col("was_hidden"), "reported_again").otherwise("persisted")
    gone = (at < F.col("last")) & (F.coalesce("after", F.lit(0)) != at + 1)
    rows = F.array(F.struct(at.alias("snapshot"), state.alias("state")), F.when(gone, F.struct((at + 1).alias("snapshot"), F.lit("fixed").alias("state"))))
    return out.select("repo", "fingerprint", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("repo", "fingerprint", "x.snapshot", "x.state")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result record per finding, as JSON, beside the report it belongs to."""
    line = F.greatest("line", F.lit(1))
    region = F.struct(line.alias("startLine"), F.when(F.col("col") != 0, F.col("col")).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    about = F.struct("score", "priority", "tool", F.col("severity").alias("toolSeverity"), F.col("is_test").alias("isTest"))
    result = F.struct(F.col("rule").alias("ruleId"), R.sarif_level(F.col("priority")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("lintmill/v1")).alias("partialFingerprints"), about.alias("properties"))
    return findings.withColumn("result", F.to_json(result))


def sarif_rules(findings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rules of each report in order of their ids, with category and tool of their first finding.

    Without ``ord`` all findings of a rule have one category and tool; they are counted in hash tables and not sorted.
    """
    if "ord" not in findings.columns:
        each = findings.groupBy(*keys, "rule", "category", "tool").agg(F.count("*").alias("n"))
        return each.groupBy(*keys, "rule").agg(F.min("category").alias("category"), F.min("tool").alias("tool"), F.sum("n").alias("n"))
    return findings.groupBy(*keys, "rule").agg(F.min_by("category", "ord").alias("category"), F.min_by("tool", "ord").alias("tool"), F.count("*").alias("n"))


#: Hashes that a distinct-count sketch keeps, as a power of two; counts up to that are exact, beyond it the relative standard error is 1 over their square root, 1.6 %.
SKETCH_LG = 12
_SKETCHED = ("repos", "reported", "suppressed")


def rule_sketches(findings: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """Per tool and rule: distinct-count sketches (binary) of its repositories, of its reported and of its human-suppressed findings.

    Such tables may be merged in any order and more than once, and may cover the same repositories: a finding counts once, by its repository, side, fingerprint and place.
    """
    human = ~F.col("suppress_reason").isin("", "vendored", "generated")
    keep = F.col("suppress_reason") == ""
    own = F.concat_ws("\u0000", "repo", "side", "fingerprint", F.col("line").cast("string"), F.col("col").cast("string"))
    counted = findings.where(keep | human)
    sketch = lambda c: F.theta_sketch_agg(c, F.lit(lg))  # noqa: E731  nulls are not counted
    return counted.groupBy("tool", "rule").agg(sketch(F.col("repo")).alias("repos"), sketch(F.when(keep, own)).alias("reported"), sketch(F.when(human, own)).alias("suppressed"))


def merged_sketches(tables: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """Any number of ``rule_sketches`` tables, in one, as one."""
    return tables.groupBy("tool", "rule").agg(*(F.theta_union_agg(c, F.lit(lg)).alias(c) for c in _SKETCHED))


def sketch_estimates(table: DataFrame) -> DataFrame:
    """The counts that a table of sketches stands for, and the rate of suppressed findings."""
    counts = table.select("tool", "rule", *(F.theta_sketch_estimate(c).alias(c) for c in _SKETCHED))
    total = F.col("reported") + F.col("suppressed")
    return counts.withColumn("rate", F.when(total == 0, 0.0).otherwise(R.rounded(F.col("suppressed") / total, 3)))


def exact_members(findings: DataFrame) -> DataFrame:
    """(tool, rule, repo): the sets beside the sketches; their union is the distinct union of such tables."""
    human = ~F.col("suppress_reason").isin("", "vendored", "generated")
    return findings.where((F.col("suppress_reason") == "") | human).select("tool", "rule", "repo").distinct()


def merged_as_whole(tables: DataFrame, whole: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """(tool, rule, close): whether ``tables`` merged tell the counts that the sketches of the ``whole`` tell.

    A merged sketch holds the least hashes of all that was put into any part, whatever the parts have in common. So it must tell the same as the
    whole's, on any data; how far both are from the true counts is chance, and no bound on that holds always.
    """
    told = lambda t, side: sketch_estimates(merged_sketches(t, lg)).select("tool", "rule", F.struct(*_SKETCHED).alias(side))
    both = told(tables, "parts").join(told(whole, "whole"), ["tool", "rule"], "full")
    return both.select("tool", "rule", F.coalesce(F.col("parts") == F.col("whole"), F.lit(False)).alias("close"))

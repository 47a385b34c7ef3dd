"""Scalar rules on the small cases that pin them."""

import pytest
from pyspark.sql import functions as F

from lintmill.functions import rules as R


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("path,want", [("pkg/foo_test.go", True), ("pkg/foo.go", False), ("testdata/sample.go", True), ("pkg/testdata/x.go", True), ("pkg/contest.go", False)])
def test_test_paths(spark, path, want):
    assert one(spark, R.is_test(F.lit(path))) is want


@pytest.mark.parametrize("path,want", [("vendor/example.com/x/y.go", True), ("pkg/vendor/x.go", True), ("pkg/vendored.go", False), ("pkg/foo.go", False)])
def test_vendored_paths(spark, path, want):
    assert one(spark, R.is_vendored(F.lit(path))) is want


@pytest.mark.parametrize("rule,want", [("lostcancel", 85), ("SA2999", 70), ("ZZ9999", 40), ("SA3000", 40), ("QF1001", 10)])
def test_priors(spark, rule, want):
    assert one(spark, R.rule_prior(F.lit(rule))) == want


@pytest.mark.parametrize("points,want", [(85, "critical"), (70, "high"), (40, "medium"), (14, "low")])
def test_priorities(spark, points, want):
    assert one(spark, R.priority(F.lit(points))) == want


def test_score_takes_the_first_discount_only(spark):
    t, f = F.lit(True), F.lit(False)
    assert [one(spark, R.score(F.lit(85), *x)) for x in ((f, f, f), (f, f, t), (f, t, t), (t, t, t))] == [85, 26, 9, 4]
    assert one(spark, R.score(F.lit(1), t, f, f)) == 1


def test_fingerprint_ignores_lines_but_not_files(spark):
    key = lambda file: one(spark, R.fingerprint(F.lit("t"), F.lit("r"), F.lit(file), F.lit("m")))
    assert key("a.go") == key("a.go") != key("b.go") and len(key("a.go")) == 16


# the cases of suppression comments, with those where a plain reading would go wrong
NOLINT = [
    ("x() //nolint", "staticcheck", "SA2001", "nolint"),
    ("x() //nolint:staticcheck", "staticcheck", "SA2001", "nolint:staticcheck"),
    ("x() //nolint:errcheck", "staticcheck", "SA2001", ""),
    ("x() // nolint:all", "GoSec", "G101", "nolint:all"),
    ("x() //nolint:govet", "go vet", "printf", "nolint:govet"),
    ("x() //nolint:staticcheck", "go vet", "printf", ""),
    ("x() // nolintlint", "go vet", "printf", "nolint"),
    ("x() //nolint: gosec because x", "GoSec", "G101", ""),
    ("x() //nolint:govet,GoSec", "GoSec", "G101", "nolint:gosec"),
    ("x()", "GoSec", "G101", ""),
]


@pytest.mark.parametrize("line,tool,rule,want", NOLINT)
def test_nolint(spark, line, tool, rule, want):
    assert one(spark, R.nolint(F.lit(line), F.lit(tool), F.lit(rule))) == want


@pytest.mark.parametrize("rules,want", [("SA2001", True), ("SA1000, SA2001", True), ("SA1000", False), ("all", True), ("sa2001", False), ("SA2001 plain words", False)])
def test_rule_lists(spark, rules, want):
    assert one(spark, R.rule_listed(F.lit(rules), F.lit("SA2001"))) is want


@pytest.mark.parametrize("version,want", [("1.21", False), ("1.22.3", True), ("go1.26", True), ("1.22rc1", False), ("", False), (" 1.23", False), ("2", False)])
def test_versions(spark, version, want):
    assert one(spark, R.version_at_least(F.lit(version), 1, 22)) is want


def test_snapshot_keys_follow_every_part(spark):
    key = lambda commit, tags: one(spark, R.snapshot_key(*(F.lit(x) for x in ("r", commit, "m", "1.22", "linux", "amd64")), F.array(*map(F.lit, tags))))
    assert key("c", ["a"]) != key("d", ["a"]) != key("d", ["b"]) and key("c", ["a b"]) == key("c", ["a", "b"]) and len(key("c", ["a"])) == 32


@pytest.mark.parametrize("text,want", [("", 0), ("ab", 1), ("né" * 4, 3)])
def test_token_estimates_count_bytes(spark, text, want):
    assert one(spark, R.token_estimate(F.lit(text))) == want


@pytest.mark.parametrize("path,want", [("a/Dockerfile", "Dockerfile"), ("dockerfile", "Dockerfile"), ("Dockerfile.dev", "Dockerfile"), ("x.TSX", "TypeScript"), ("x.md", None), ("noext", None)])
def test_languages(spark, path, want):
    assert one(spark, R.language(F.lit(path))) == want


def test_unknown_priority_is_an_error(spark):
    with pytest.raises(Exception, match="unknown priority"):
        one(spark, R.priority_rank(F.lit("urgent")))


@pytest.mark.parametrize("url,want", [("https://h.org/a b/c.d.git", "a_b__c.d"), ("https://h.org/o/r/", "o__r"), ("x", "x")])
def test_repo_names(spark, url, want):
    assert one(spark, R.repo_name(F.lit(url))) == want

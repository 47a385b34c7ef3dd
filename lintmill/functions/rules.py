"""Scalar rules for findings: identity, scores, classes of paths and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prior of each rule, and of rule families in order of precedence.
PRIORS = {
    "lostcancel": 85, "copylocks": 85, "loopclosure": 80, "SA2000": 85, "SA2001": 80, "SA2002": 70, "SA2003": 85, "SA1012": 80, "SA1015": 75,
    "SA5001": 85, "SA5007": 80, "SA5011": 80, "SA4006": 55, "SA4010": 55, "SA1019": 40, "SA1029": 45, "SA9003": 25,
    "unreachable": 30, "assign": 35, "printf": 50, "structtag": 45, "unsafeptr": 70, "vet.other": 40,
}
FAMILY_PRIORS = (("SA2", 70), ("SA5", 65), ("SA1", 45), ("SA4", 45), ("SA6", 25), ("SA9", 40), ("S1", 15), ("ST1", 10), ("QF1", 10))
DEFAULT_PRIOR = 40
# Least scores of priorities, and what kinds of files leave of a prior.
PRIORITIES = (("critical", 80), ("high", 55), ("medium", 30))
DISCOUNTS = (("vendored", 0.05), ("generated", 0.10), ("test", 0.30))
# Phrases of vet messages and their rules, in order; categories of rules and rule families.
VET_PHRASES = (
    ("lostcancel", ("cancel function", "lost cancel")), ("copylocks", ("passes lock by value", "copies lock value")), ("loopclosure", ("loop variable",)),
    ("unreachable", ("unreachable code",)), ("printf", ("format", "printf")), ("assign", ("self-assignment",)), ("unsafeptr", ("possible misuse of",)),
    ("structtag", ("struct field", "struct tag")),
)
VET_CATEGORIES = {
    "lostcancel": "CTX.PROPAGATION", "copylocks": "CONC.MISUSE", "loopclosure": "CONC.MISUSE", "printf": "API.MISUSE", "structtag": "API.MISUSE",
    "unsafeptr": "API.MISUSE", "unreachable": "CODE.SMELL", "assign": "CODE.SMELL",
}
FAMILY_CATEGORIES = (
    ("SA1", "API.MISUSE"), ("SA2", "CONC.MISUSE"), ("SA3", "TEST.MISUSE"), ("SA4", "CODE.SMELL"), ("SA5", "CORRECTNESS"), ("SA6", "PERF"),
    ("SA9", "CORRECTNESS"), ("S1", "CODE.SMELL"), ("ST1", "CODE.STYLE"), ("QF1", "CODE.STYLE"),
)
# Languages by file extension.
LANGUAGES = {
    "go": "Go", "py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "rs": "Rust", "c": "C", "h": "C",
    "cc": "C++", "cpp": "C++", "hpp": "C++", "cu": "CUDA", "cuh": "CUDA", "java": "Java", "sh": "Shell", "yaml": "YAML", "yml": "YAML",
    "json": "JSON", "proto": "Protobuf", "tf": "Terraform",
}
LEVELS = ("hypothesis", "static_fact", "corroborated", "reproduced", "patch_verified")


def _chain(pairs: list[tuple[Column, object]], default: object) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def fingerprint(tool: Column, rule: Column, file: Column, message: Column) -> Column:
    """Identity of a finding that survives line moves: 16 hex digits over tool, rule, file and message."""
    parts = [F.coalesce(c, F.lit("")) for c in (tool, rule, file, message)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def rule_prior(rule: Column) -> Column:
    exact = F.create_map(*[F.lit(x) for pair in PRIORS.items() for x in pair])
    return F.coalesce(exact[rule], _chain([(rule.startswith(p), F.lit(v)) for p, v in FAMILY_PRIORS], F.lit(DEFAULT_PRIOR)))


def score(prior: Column, vendored: Column, generated: Column, test: Column) -> Column:
    flags = dict(zip(("vendored", "generated", "test"), (vendored, generated, test), strict=True))
    discount = _chain([(flags[name], F.lit(d)) for name, d in DISCOUNTS], F.lit(1.0))
    return F.greatest(F.lit(1), F.floor(prior * discount + 0.5).cast("int"))


def priority(points: Column) -> Column:
    return _chain([(points >= least, F.lit(name)) for name, least in PRIORITIES], F.lit("low"))


def priority_rank(name: Column) -> Column:
    """0 for low to 3 for critical; another name is an error."""
    low = F.lower(name)
    return _chain([(low == n, F.lit(i)) for i, n in enumerate(("low", "medium", "high", "critical"))], F.raise_error(F.concat(F.lit("unknown priority "), low)).cast("int"))


def evidence_rank(name: Column) -> Column:
    """The level's number on the ladder; another name is an error."""
    return _chain([(name == n, F.lit(i)) for i, n in enumerate(LEVELS)], F.raise_error(F.concat(F.lit("unknown evidence level "), name)).cast("int"))


def is_test(path: Column) -> Column:
    return path.endswith("_test.go") | path.startswith("testdata/") | path.contains("/testdata/")


def is_vendored(path: Column) -> Column:
    return path.startswith("vendor/") | path.contains("/vendor/")


def vet_rule(message: Column) -> Column:
    low = F.lower(message)
    return _chain([(low.contains(p), F.lit(rule)) for rule, phrases in VET_PHRASES for p in phrases], F.lit("vet.other"))


def vet_category(rule: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in VET_CATEGORIES.items() for x in pair])[rule], F.lit("UNCATEGORIZED"))


def family_category(rule: Column) -> Column:
    return _chain([(rule.startswith(p), F.lit(c)) for p, c in FAMILY_CATEGORIES], F.lit("UNCATEGORIZED"))


def language(path: Column) -> Column:
    """The language of a file, null for an unknown one."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(name, "\\.([^.]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when((F.lower(name) == "dockerfile") | name.startswith("Dockerfile."), "Dockerfile").otherwise(known[extension])


def relative_path(path: Column, root: Column) -> Column:
    inside = F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)
    return F.regexp_replace(inside, "^\\./", "")


def linter_names(tool: Column, rule: Column) -> Column:
    """Names under which a suppression comment may address a finding's tool."""
    low = F.lower(tool)
    static = F.when(rule.startswith("ST1"), F.array(F.lit("staticcheck"), F.lit("stylecheck"))).when(rule.startswith("S1"), F.array(F.lit("staticcheck"), F.lit("gosimple")))
    return F.when(low == "go vet", F.array(F.lit("govet"), F.lit("vet"))).when(low == "staticcheck", static.otherwise(F.array(F.lit("staticcheck")))).otherwise(F.array(low))


# How suppression comments are written.
NOLINT = "//\\s*nolint(?::\\s*([\\w\\-,\\s]+))?"
LINT_IGNORE = "//\\s*lint:ignore\\s+([\\w,\\s]+)"
FILE_IGNORE = "//\\s*lint:file-ignore\\s+([\\w,\\s]+)"


def nolint(line: Column, tool: Column, rule: Column) -> Column:
    """The directive of a nolint comment that hits the finding, or an empty string."""
    listed = F.regexp_extract(line, NOLINT, 1)
    names = F.concat(F.array(F.lit("all")), linter_names(tool, rule))
    hits = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(F.lower(x), F.lit(" \t\n\r"))), lambda x: F.array_contains(names, x))
    hit = F.coalesce(F.concat(F.lit("nolint:"), F.get(hits, 0)), F.lit(""))
    return F.when(~F.coalesce(line, F.lit("")).rlike(NOLINT), "").when(F.trim(listed) == "", "nolint").otherwise(hit)


def rule_listed(rules: Column, rule: Column) -> Column:
    return F.arrays_overlap(F.transform(F.split(rules, ","), lambda x: F.trim(x)), F.array(rule, F.lit("all")))


def repo_name(url: Column) -> Column:
    """Last two path segments without .git, sanitised and joined by two underscores."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, "/$", ""), "\\.git$", ""), "/")
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9.\\-]", "_")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return F.when(before.isNull(), clean(last)).otherwise(F.concat(clean(before), F.lit("__"), clean(last)))


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 12)


def truncated(text: Column, n: int) -> Column:
    """The first line, cut to n - 1 characters and three dots when it is longer than n."""
    line = F.substring_index(text, "\n", 1)
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n - 1), F.lit("..."))).otherwise(line)


def rounded(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def version_pair(version: Column) -> Column:
    """(major, minor) of a Go version, null if either part is no integer."""
    parts = F.split(F.regexp_replace(version, "^go", ""), "\\.")
    part = lambda i: F.when(F.get(parts, i).rlike("^[+-]?[0-9]+$"), F.get(parts, i).cast("bigint"))
    return F.when(part(0).isNotNull() & part(1).isNotNull(), F.struct(part(0).alias("major"), part(1).alias("minor")))


def version_at_least(version: Column, major: int, minor: int) -> Column:
    v = version_pair(version)
    return F.coalesce((v["major"] > major) | ((v["major"] == major) & (v["minor"] >= minor)), F.lit(False))


def moniker(name: Column) -> Column:
    return F.concat(F.lit("fn:"), F.substring(F.sha2(name, 256), 1, 24))


def snapshot_key(repo: Column, commit: Column, module: Column, version: Column, goos: Column, goarch: Column, tags: Column) -> Column:
    text = F.concat(repo, F.lit("\n"), commit, F.lit("\n"), module, F.lit("\n"), version, F.lit("\n"), goos, F.lit("/"), goarch, F.lit("\n["), F.array_join(F.coalesce(tags, F.array()), " "), F.lit("]\n"))
    return F.substring(F.sha2(text, 256), 1, 32)


def token_estimate(text: Column) -> Column:
    n = F.octet_length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def level_name(level: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), level), F.lit(LEVELS[0]))


def verdict(level: Column) -> Column:
    return F.when(level >= 3, "CONFIRMED").when(level == 2, "LIKELY").otherwise("POSSIBLE")


def edge_confidence(vta_used: Column, in_cha: Column) -> Column:
    return F.when(~vta_used, F.lit(0.75)).when(in_cha, F.lit(0.92)).otherwise(F.lit(0.60))


def sarif_level(name: Column) -> Column:
    return F.when(name.isin("critical", "high"), "error").when(name == "medium", "warning").otherwise("note")

"""findings are shuffled as three numbers, and of source lines only their comments."""

import re

from pyspark.sql import functions as F

from lintmill.functions import rules as R
from lintmill.plans.queries import QUERIES
from lintmill.sources import tables as T


def test_packed_findings_come_back(spark):
    kinds = {"repo": "bigint", "dir": "bigint", "doc_id": "bigint", "tool": "int", "rule": "int", "message": "int", "base": "boolean", "line": "int", "col": "int"}
    ends = [-(2**31), -1, 0, 1, 7, 2**31 - 1, None]
    rows = [(i % 8, i % 5, i << 40, i % 3, i % 22, message, i % 2 == 0, ends[(i + 3) % 7], ends[i % 7]) for i in range(53) for message in (-2, -1, 0, 1, 2, None)]
    coded = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    packed = T._packed(coded)
    assert packed.columns == ["doc_id", "line", "rest"]
    back = T._unpacked(packed).select(*kinds)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, coded.collect()))


def test_texts_of_lines_are_not_shuffled(spark, sf_dir):
    plan = QUERIES["flt02_classified"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\btext#\d+ AS __(here|above)", plan)
    assert re.search(r"Exchange hashpartitioning\(doc_id#\S+, line#\S+, \d+\), REPARTITION_BY_NUM", plan)


def test_a_comment_alone_says_what_its_line_says(spark):
    lines = [
        "x := 1 //nolint", "x //nolint:govet, GoSec // why", "a // lint:ignore SA2001 words //nolint:all", "//nolint //lint:ignore SA1019,SA2001", "//nolint:vet//lint:ignore all", "//lint:ignore SA1 (b) //lint:ignore SA2",
        "//nolint: -", "// nolint:\tstaticcheck,\tx", "//lint:ignore", "no comment", "", "//nolint://nolint:govet", "é //nolint:é",
    ]
    rows = spark.createDataFrame([(t, tool, rule) for t in lines for tool, rule in (("go vet", "printf"), ("staticcheck", "SA2001"), ("GoSec", "G101"))], "text string, tool string, rule string")
    short = F.concat(F.regexp_extract("text", R.NOLINT, 0), F.regexp_extract("text", R.LINT_IGNORE, 0))

    def told(text):
        return F.struct(R.nolint(text, F.col("tool"), F.col("rule")), text.rlike(R.LINT_IGNORE), F.regexp_extract(text, R.LINT_IGNORE, 1))

    assert rows.where(told(F.col("text")) != told(short)).count() == 0

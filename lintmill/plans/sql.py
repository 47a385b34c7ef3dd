"""Logical tables and scalar rules in DuckDB's SQL, written apart from the DataFrame code they check."""

from __future__ import annotations

from lintmill.sources import tables as S


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


# Fixed values, stated here once more so that a wrong one in the library shows.
VET_CATEGORY = """CASE rule WHEN 'lostcancel' THEN 'CTX.PROPAGATION' WHEN 'copylocks' THEN 'CONC.MISUSE' WHEN 'loopclosure' THEN 'CONC.MISUSE' WHEN 'printf' THEN 'API.MISUSE' WHEN 'structtag' THEN 'API.MISUSE'
  WHEN 'unsafeptr' THEN 'API.MISUSE' WHEN 'unreachable' THEN 'CODE.SMELL' WHEN 'assign' THEN 'CODE.SMELL' ELSE 'UNCATEGORIZED' END"""
FAMILY_CATEGORY = """CASE WHEN rule LIKE 'SA1%' THEN 'API.MISUSE' WHEN rule LIKE 'SA2%' THEN 'CONC.MISUSE' WHEN rule LIKE 'SA3%' THEN 'TEST.MISUSE' WHEN rule LIKE 'SA4%' THEN 'CODE.SMELL' WHEN rule LIKE 'SA5%' THEN 'CORRECTNESS'
  WHEN rule LIKE 'SA6%' THEN 'PERF' WHEN rule LIKE 'SA9%' THEN 'CORRECTNESS' WHEN rule LIKE 'S1%' THEN 'CODE.SMELL' WHEN rule LIKE 'ST1%' THEN 'CODE.STYLE' WHEN rule LIKE 'QF1%' THEN 'CODE.STYLE' ELSE 'UNCATEGORIZED' END"""
PRIOR = """CASE WHEN rule IN ('lostcancel', 'copylocks', 'SA2000', 'SA2003', 'SA5001') THEN 85 WHEN rule IN ('loopclosure', 'SA2001', 'SA1012', 'SA5007', 'SA5011') THEN 80 WHEN rule = 'SA1015' THEN 75
  WHEN rule IN ('SA2002', 'unsafeptr') THEN 70 WHEN rule IN ('SA4006', 'SA4010') THEN 55 WHEN rule = 'printf' THEN 50 WHEN rule IN ('SA1029', 'structtag') THEN 45 WHEN rule IN ('SA1019', 'vet.other') THEN 40
  WHEN rule = 'assign' THEN 35 WHEN rule = 'unreachable' THEN 30 WHEN rule = 'SA9003' THEN 25
  WHEN rule LIKE 'SA2%' THEN 70 WHEN rule LIKE 'SA5%' THEN 65 WHEN rule LIKE 'SA1%' THEN 45 WHEN rule LIKE 'SA4%' THEN 45 WHEN rule LIKE 'SA6%' THEN 25 WHEN rule LIKE 'SA9%' THEN 40
  WHEN rule LIKE 'S1%' THEN 15 WHEN rule LIKE 'ST1%' THEN 10 WHEN rule LIKE 'QF1%' THEN 10 ELSE 40 END"""
VET_RULE = """CASE WHEN lower(message) LIKE '%cancel function%' OR lower(message) LIKE '%lost cancel%' THEN 'lostcancel' WHEN lower(message) LIKE '%passes lock by value%' OR lower(message) LIKE '%copies lock value%' THEN 'copylocks'
  WHEN lower(message) LIKE '%loop variable%' THEN 'loopclosure' WHEN lower(message) LIKE '%unreachable code%' THEN 'unreachable' WHEN lower(message) LIKE '%format%' OR lower(message) LIKE '%printf%' THEN 'printf'
  WHEN lower(message) LIKE '%self-assignment%' THEN 'assign' WHEN lower(message) LIKE '%possible misuse of%' THEN 'unsafeptr' WHEN lower(message) LIKE '%struct field%' OR lower(message) LIKE '%struct tag%' THEN 'structtag' ELSE 'vet.other' END"""
NOLINT = r"//\s*nolint(?::\s*([\w\-,\s]+))?"
LINT_IGNORE = r"//\s*lint:ignore\s+([\w,\s]+)"
FILE_IGNORE = r"//\s*lint:file-ignore\s+([\w,\s]+)"
PRIORITY = "CASE WHEN score >= 80 THEN 'critical' WHEN score >= 55 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END"
IS_TEST = "ends_with({0}, '_test.go') OR starts_with({0}, 'testdata/') OR contains({0}, '/testdata/')"
IS_VENDORED = "starts_with({0}, 'vendor/') OR contains({0}, '/vendor/')"
FINGERPRINT = "substr(sha256(tool || '|' || rule || '|' || file || '|' || message), 1, 16)"
ORD = "struct_pack(" + ", ".join(f"{c} := {c}" for c in S.ORDER) + ")"

FINDINGS = f"""
f0 AS (
  SELECT 'org__repo' || (l_suppkey % 8) AS repo, CASE l_linestatus WHEN 'F' THEN 'base' ELSE 'head' END AS side,
    CASE l_returnflag WHEN 'A' THEN 'go vet' WHEN 'N' THEN 'staticcheck' ELSE 'GoSec' END AS tool,
    CASE l_returnflag WHEN 'A' THEN ({_list(S.VET_RULES)})[l_partkey % 9 + 1] WHEN 'N' THEN ({_list(S.STATIC_RULES)})[l_partkey % 22 + 1] ELSE 'G10' || (l_partkey % 5) END AS rule,
    ({_list(S.DIRS)})[l_suppkey % 5 + 1] || '/f' || (l_partkey % nd) || CASE WHEN l_partkey % nd % 5 = 0 THEN '_test.go' ELSE '.go' END AS file,
    l_partkey % nd AS doc_id, CAST(floor(l_quantity) AS INT) AS line, CAST(l_linenumber AS INT) AS col,
    'm' || CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) % 3 AS VARCHAR) AS message, l_shipdate AS seen, {ORD} AS ord
  FROM lineitem, (SELECT greatest(1, count(*)) AS nd FROM documents)),
fr AS (
  SELECT *, CASE tool WHEN 'go vet' THEN {VET_CATEGORY} WHEN 'staticcheck' THEN {FAMILY_CATEGORY} ELSE 'UNCATEGORIZED' END AS category,
    CASE tool WHEN 'go vet' THEN 'medium' ELSE 'warning' END AS severity, {FINGERPRINT} AS fingerprint
  FROM f0),
dd AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY repo, side, fingerprint, line, col ORDER BY ord) = 1)"""

LINES = f"""
l0 AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
sl AS (
  SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN doc_id % 10 = 9 AND line_no = 1 THEN '// Code generated by tool. DO NOT EDIT.'
    WHEN doc_id % 13 = 5 AND line_no = 3 THEN raw || ' //lint:file-ignore SA1019,SA2001'
    ELSE raw || coalesce(({_list(S.DIRECTIVES)})[(doc_id * 7 + line_no) % 23 + 1], '') END AS text
  FROM l0)"""

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_NAMES = """['all'] || CASE WHEN lower(tool) = 'go vet' THEN ['govet', 'vet'] WHEN lower(tool) = 'staticcheck' THEN
  CASE WHEN starts_with(rule, 'ST1') THEN ['staticcheck', 'stylecheck'] WHEN starts_with(rule, 'S1') THEN ['staticcheck', 'gosimple'] ELSE ['staticcheck'] END ELSE [lower(tool)] END"""


def nolint(line: str) -> str:
    listed = f"regexp_extract({line}, '{NOLINT}', 1)"
    hit = f"list_filter(list_transform(string_split({listed}, ','), lambda x: trim(lower(x), {_BLANK})), lambda x: list_contains({_NAMES}, x))[1]"
    return f"CASE WHEN {line} IS NULL OR NOT regexp_matches({line}, '{NOLINT}') THEN '' WHEN trim({listed}) = '' THEN 'nolint' ELSE coalesce('nolint:' || {hit}, '') END"


def listed(rules: str) -> str:
    return f"list_has_any(list_transform(string_split({rules}, ','), lambda x: trim(x)), [rule, 'all'])"


CLASSIFIED = f"""{FINDINGS},{LINES},
gen AS (
  SELECT doc_id FROM (
    SELECT doc_id, min(line_no) FILTER (regexp_matches(trim(text, {_BLANK}), '^// Code generated .* DO NOT EDIT\\.$')) AS m, min(line_no) FILTER (starts_with(trim(text, {_BLANK}), 'package ')) AS p
    FROM sl WHERE line_no <= 20 GROUP BY doc_id) WHERE m < coalesce(p, 21)),
fi AS (SELECT doc_id, line_no, regexp_extract(text, '{FILE_IGNORE}', 1) AS rules FROM sl WHERE line_no <= 50 AND regexp_matches(text, '{FILE_IGNORE}')),
hit AS (SELECT d.*, (SELECT first(trim(fi.rules) ORDER BY fi.line_no) FROM fi WHERE fi.doc_id = d.doc_id AND {listed('fi.rules')}) AS fhit FROM dd d),
sup AS (
  SELECT d.*, {IS_TEST.format('d.file')} AS is_test, {IS_VENDORED.format('d.file')} AS is_vendored, d.doc_id IN (SELECT doc_id FROM gen) AS is_generated,
    CASE WHEN d.line < 1 THEN '' ELSE coalesce('lint:file-ignore ' || fhit, nullif({nolint('h.text')}, ''), nullif({nolint('a.text')}, ''),
      CASE WHEN regexp_matches(a.text, '{LINT_IGNORE}') AND {listed(f"regexp_extract(a.text, '{LINT_IGNORE}', 1)")} THEN 'lint:ignore ' || trim(regexp_extract(a.text, '{LINT_IGNORE}', 1)) END, '') END AS directive,
    {PRIOR} AS prior
  FROM hit d LEFT JOIN sl h ON h.doc_id = d.doc_id AND h.line_no = d.line LEFT JOIN sl a ON a.doc_id = d.doc_id AND a.line_no = d.line - 1),
sc AS (
  SELECT *, CASE WHEN is_vendored THEN 'vendored' WHEN is_generated THEN 'generated' ELSE directive END AS suppress_reason,
    greatest(1, CAST(floor(prior * CASE WHEN is_vendored THEN 0.05::DOUBLE WHEN is_generated THEN 0.10::DOUBLE WHEN is_test THEN 0.30::DOUBLE ELSE 1.0::DOUBLE END + 0.5) AS INT)) AS score
  FROM sup),
cl AS (SELECT *, {PRIORITY} AS priority, suppress_reason NOT IN ('', 'vendored', 'generated') AS human FROM sc)"""

EDGES = """
e0 AS (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN 'CALLS' WHEN 'O' THEN 'READS' ELSE 'WRITES' END AS kind, o_orderkey % 300 AS field,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.92::DOUBLE WHEN '4' THEN 0.92::DOUBLE WHEN '2' THEN 0.75::DOUBLE WHEN '3' THEN 0.60::DOUBLE ELSE 0.50::DOUBLE END AS confidence
  FROM orders),
ed AS (
  SELECT kind, 'fn:' || (o_custkey % 500) AS src, CASE kind WHEN 'CALLS' THEN 'fn:' || ((o_orderkey * 7 + 3) % 500) ELSE 'field:' || field END AS dst,
    CASE confidence WHEN 0.75::DOUBLE THEN 'cha' WHEN 0.50::DOUBLE THEN 'model' ELSE 'vta' END AS producer, confidence,
    CASE WHEN field % 2 = 0 THEN ['L' || (o_orderkey % 3), 'L9'] WHEN o_orderkey % 17 = 0 THEN []::VARCHAR[] ELSE ['L' || (o_orderkey % 4)] END AS locks, o_orderkey
  FROM e0)"""

UNITS = """
un AS (
  SELECT doc_id // 50 AS grp, 'doc:' || doc_id AS id, doc_id AS seq, ([10, 100, 90, 70, 60, 50, 40, 30, 20])[doc_id % 9 + 1] AS priority,
    CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars // 4 END AS tokens, coalesce(text, '') AS text
  FROM documents),
ut AS (SELECT *, CAST(CASE WHEN tokens = 0 THEN CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, strlen(text) // 4) END ELSE tokens END AS BIGINT) AS t FROM un)"""

PREDICTIONS = """
pr AS (SELECT toxic AS y, (n_chars * 37 % 101) / 101.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
pp AS (SELECT y, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM pr)"""

"""Adapters from analyzer output and repository files to tables. Each takes lines as a DataFrame, as spark.read.text gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.functions import rules as R

VET_LINE = "^(.*?):(\\d+):(\\d+):\\s+(.*)$"
STATIC_SCHEMA = "code string, severity string, message string, location struct<file:string,line:int,column:int>, _bad string"
#: Directories that a repository walk leaves out. Fixed values.
SKIPPED_DIRS = (".git", "node_modules", ".idea", ".vscode", "__pycache__", ".venv")
MARKER = "^// Code generated .* DO NOT EDIT\\.$"


def parse_vet(lines: DataFrame, root: Column | None = None) -> DataFrame:
    """Findings in plain vet output; comment lines, blank lines and lines without a column are dropped. Other columns pass through."""
    text = F.trim(F.col("value"), F.lit(" \t\r\n"))
    kept = lines.withColumn("value", text).where((F.col("value") != "") & ~F.col("value").startswith("#") & F.col("value").rlike(VET_LINE))
    part = lambda i: F.regexp_extract("value", VET_LINE, i)
    out = kept.withColumns({"tool": F.lit("go vet"), "file": R.relative_path(part(1), root if root is not None else F.lit("/")), "line": part(2).cast("int"), "col": part(3).cast("int"), "message": part(4)})
    out = out.withColumn("rule", R.vet_rule(F.col("message"))).withColumns({"category": R.vet_category(F.col("rule")), "severity": F.lit("medium")})
    return out.withColumn("fingerprint", R.fingerprint(*(F.col(c) for c in ("tool", "rule", "file", "message")))).drop("value")


def parse_staticcheck(lines: DataFrame, root: Column | None = None) -> DataFrame:
    """Findings in newline-delimited JSON; lines that don't start with a brace and malformed ones are skipped, missing fields are empty or 0."""
    kept = lines.where(F.col("value").startswith("{"))
    kept = kept.withColumn("__j", F.from_json("value", STATIC_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("__j._bad is null")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = kept.withColumns({
        "tool": F.lit("staticcheck"), "rule": text("__j.code"), "severity": text("__j.severity"), "message": text("__j.message"),
        "file": R.relative_path(text("__j.location.file"), root if root is not None else F.lit("/")),
        "line": F.coalesce("__j.location.line", F.lit(0)), "col": F.coalesce("__j.location.column", F.lit(0)),
    })
    out = out.withColumn("category", R.family_category(F.col("rule")))
    return out.withColumn("fingerprint", R.fingerprint(*(F.col(c) for c in ("tool", "rule", "file", "message")))).drop("value", "__j")


def repo_list(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Distinct URLs in order of their first line; text after a hash sign and blank lines are dropped."""
    url = F.trim(F.substring_index("value", "#", 1), F.lit(" \t\r\n"))
    return lines.select(url.alias("url"), order).where("url <> ''").groupBy("url").agg(F.min(order).alias(order)).withColumn("name", R.repo_name(F.col("url")))


def build_config(lines: DataFrame, key: str = "repo") -> DataFrame:
    """module and Go version per go.mod (rows key, line_no, value): the last module and go lines, toolchain only before any go line."""
    v = F.trim("value")
    go = F.when(v.startswith("go "), F.trim(F.substring(v, 4, 1000)))
    tool = F.when(v.startswith("toolchain go"), F.trim(F.substring(v, 13, 1000)))
    module = F.when(v.startswith("module "), F.trim(F.substring(v, 8, 1000)))
    rows = lines.select(key, "line_no", module.alias("m"), go.alias("g"), tool.alias("t"))
    first_go = F.min(F.when(F.col("g").isNotNull(), F.col("line_no")))
    stats = rows.groupBy(key).agg(
        F.max_by("m", F.when(F.col("m").isNotNull(), F.col("line_no"))).alias("module"),
        F.max_by("g", F.when(F.col("g").isNotNull(), F.col("line_no"))).alias("g"),
        F.min_by("t", F.when(F.col("t").isNotNull(), F.col("line_no"))).alias("t"),
        first_go.alias("first_go"),
    )
    version = F.coalesce("g", "t", F.lit(""))
    return stats.select(key, F.coalesce("module", F.lit("")).alias("module"), version.alias("go_version"), F.lit("linux").alias("goos"), F.lit("amd64").alias("goarch"))


def inventory(files: DataFrame) -> DataFrame:
    """Known files (path, text): language, lines, bytes, is_test, is_vendored, is_generated (marker in the first 20 lines)."""
    skipped = F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda d: d.isin(*SKIPPED_DIRS))
    known = files.withColumn("language", R.language(F.col("path"))).where(F.col("language").isNotNull() & ~skipped)
    body = F.regexp_replace("text", "\n$", "")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split(body, "\n")))
    generated = F.exists(F.slice(F.split("text", "\n"), 1, 20), lambda x: x.rlike(MARKER))
    return known.select("path", "language", lines.cast("bigint").alias("lines"), F.octet_length("text").cast("bigint").alias("bytes"), R.is_test(F.col("path")).alias("is_test"), R.is_vendored(F.col("path")).alias("is_vendored"), generated.alias("is_generated"))


def walk(spark, root: str) -> DataFrame:
    """Files (path, text) below a directory, for ``inventory``. Spark's reader leaves out empty files, so these come from a listing of the directory."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing, empty = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while listing.hasNext():
        status = listing.next()
        if not status.getLen():
            empty.append((status.getPath().toString(), ""))
    rows = raw.select("path", F.col("content").cast("string").alias("text")).union(spark.createDataFrame(empty, "path string, text string"))
    return rows.withColumn("path", F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", ""))


#: A longer line ends what is read of a file.
MAX_LINE_BYTES = 4 << 20


def file_lines(files: DataFrame, key: str = "path", max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """(key, line_no, text) of the lines of files (key, text): 1-based, without a carriage return at their end; a line break at the file's end adds none.

    Reading stops before a line of more than ``max_line_bytes``. A null text, as of an unreadable file, has no lines.
    """
    cut = F.split("text", "\n")
    whole = F.when(F.endswith("text", F.lit("\n")) | (F.col("text") == ""), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    lines = files.select(key, F.posexplode(whole).alias("pos", "raw"), F.array_position(F.transform(whole, lambda x: F.octet_length(x) > max_line_bytes), True).alias("long"))
    read = lines.where((F.col("long") == 0) | (F.col("pos") + 1 < F.col("long")))
    return read.select(key, (F.col("pos") + 1).alias("line_no"), F.regexp_replace("raw", "\r\\z", "").alias("text"))


OCCURRENCES = "moniker string, path string, line int, col int, is_definition boolean"
CHUNKS = "path string, start_line int, end_line int, kind string, name string, text string"


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbol occurrences of an index as JSON lines, with their place in input order; rows without a moniker are left out."""
    return spark.read.schema(OCCURRENCES).json(path).where("moniker is not null")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Syntax chunks of source files as JSON lines; a chunk that ends before it starts is left out."""
    return spark.read.schema(CHUNKS).json(path).where("path is not null and end_line >= start_line")

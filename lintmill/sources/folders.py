"""Whole folders of analyzer output as findings, as a table or as a stream.

Files lie at ``root/<repo>/<side>/<tool>.<anything>``, as plain text or compressed. Spark's own text source reads them: it splits
large files, opens any store that Spark does, remembers in its checkpoint what a stream has taken, and what a query does not need is not built.
An adapter is a function from lines (value, other columns) to findings; ``ADAPTERS`` is the registry, in the order in which tools count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.sources.text import parse_staticcheck, parse_vet

#: By the name of a file: the adapter of its lines.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"vet": parse_vet, "staticcheck": parse_staticcheck}


def tool_lines(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """(repo, side, source, value) of every line of every file, source being the file's name up to its first dot; folders of another depth are left out."""
    reader = spark.readStream if stream else spark.read
    lines = reader.option("recursiveFileLookup", True).text(root)
    # what follows the root, whatever scheme or host a path begins with
    below = F.regexp_extract(F.col("_metadata.file_path"), f"^.*?/*{_quoted(root)}/+(.*)$", 1)
    parts = F.split(below, "/")
    decoded = lambda i: F.url_decode(F.replace(F.get(parts, F.lit(i)), F.lit("+"), F.lit("%2B")))  # noqa: E731  paths come encoded
    out = lines.select("value", parts.alias("parts"), decoded(0).alias("repo"), decoded(1).alias("side"), F.substring_index(F.get(parts, F.lit(2)), ".", 1).alias("source"))
    return out.where(F.size("parts") == 3).drop("parts")


def _quoted(root: str) -> str:
    import re
    from urllib.parse import quote, urlparse

    return re.escape(quote(urlparse(root).path.strip("/")))


def findings_of(lines: DataFrame, adapters: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """The findings in the lines of all known tools, with the tool's ``ordinal``; lines of other files are left out. Works on a table and on a stream."""
    out = None
    for ordinal, (source, adapter) in enumerate((ADAPTERS if adapters is None else adapters).items()):
        one = adapter(lines.where(F.col("source") == source).drop("source")).withColumn("ordinal", F.lit(ordinal))
        out = one if out is None else out.unionByName(one)
    return out

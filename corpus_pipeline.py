"""A training corpus in five stages, each of which reads what the one before it wrote.

Null texts go in the first stage, as do very short ones. Rows with a null id stay until the end; repeated rows of one id are each judged by
themselves and stay together. An empty table runs through all stages and gives no pieces. Columns beside doc_id, text and n_chars pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintmill.llm.common import table, written
from lintmill.llm.decontaminate import decontaminate
from lintmill.llm.jaccard import drop_near_copies
from lintmill.llm.line_dedup import dedup_lines
from lintmill.llm.packing import pack
from lintmill.llm.quality import clean
from lintmill.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines."""
    return clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without runs of lines that an earlier one has."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return drop_near_copies(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 1024."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("benchmarks", benchmarks), ("packing", packing)]

#: Tokenising and packing cannot be written in SQL; tests/llm/test_pipeline.py holds each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

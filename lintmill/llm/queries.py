"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm import divergence, fill_middle, quality
from lintmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.line_dedup import deduplicated

    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__deleted_lines").alias("deleted_lines"), F.col("__deleted_words").alias("deleted_words"), F.col("__clean").alias("text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.training_order import materialise

    return materialise(table(spark, sf_dir, "documents"), tokenizer_path()).select("slot", "shard", "byte_offset", "ids_crc32")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.lm import score

    return score(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintmill.llm.html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards that documents were dealt to by their source, a third of them to one, to 24 of nearly equal bytes."""
    from lintmill.llm.reshard import report

    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    return report(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(16)), place)


QUERIES: dict[str, Query] = {
    "op1_jaccard": op1_jaccard,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_training_order": op4_training_order,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_lm": op7_lm,
    "op8_decontaminate": op8_decontaminate,
    "op9_secrets": op9_secrets,
    "op10_html": op10_html,
    "op11_fill_middle": op11_fill_middle,
    "op12_divergence": op12_divergence,
    "op13_reshard": op13_reshard,
}
ORACLES: dict[str, str] = {"op3_quality": quality.ORACLE, "op11_fill_middle": fill_middle.ORACLE, "op12_divergence": divergence.ORACLE}

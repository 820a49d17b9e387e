"""The dealt operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.oracle import ORACLE  # noqa: F401  read by the driver entry
from strata.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.minimax_shards import shard

    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.best_fit import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.wavelet import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.decontaminate import digest, find

    return digest(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.substrings import digest

    return digest(table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.suffixes import digest

    return digest(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))




QUERIES = {
    "op6_minhash": op6_minhash,
    "op9_suffixes": op9_suffixes,
    "op3_substrings": op3_substrings,
    "op1_html_text": op1_html_text,
    "op10_warc": op10_warc,
    "op4_winnowing": op4_winnowing,
    "op2_wavelet": op2_wavelet,
    "op5_best_fit": op5_best_fit,
    "op7_minimax_shards": op7_minimax_shards,
    "op8_quality_rules": op8_quality_rules,
}

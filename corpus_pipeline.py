"""The corpus pipeline: five stages over ``documents``, each on its predecessor's rows.

Quality rules drop what they reject; of each group of near duplicates the
smallest id stays; words of repeated passages are cut out; documents with a
benchmark passage go; the rest is packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.best_fit import pack
from strata.llm.common import Scratch
from strata.llm.decontaminate import drop_contaminated
from strata.llm.minhash import near_duplicates
from strata.llm.quality_rules import keep_clean
from strata.llm.substrings import remove
from strata.session import ship


#: Near duplicates share this much of their sets of five-word shingles.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = near_duplicates(docs, shingle=NEAR_WORDS, percent=NEAR_PERCENT).where("kept").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_kept")).distinct()
    return docs.join(kept, F.coalesce(docs["doc_id"], F.lit(2**63 - 1)) == kept["_kept"], "left_semi")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return remove(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Near duplicates and token ids are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs

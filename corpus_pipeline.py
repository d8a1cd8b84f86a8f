"""Corpus preparation in stages, each over all that the one before it kept.

Quality rules drop documents; of near duplicates one document stays; passages that stand in several places are cut; documents with a
benchmark phrase go; what is left is encoded. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import bpe, decontam, jaccard, quality, repeats
from cinelake.llm.common import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, percent=80, size=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.remove(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of every document, also of those that the cuts left empty."""
    ids = bpe.encode(docs, *bpe.vocabulary())
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("substring dedup", substring_dedup), ("decontamination", decontaminate), ("encoding", encode)]
#: Byte-pair encoding, the component search and the verdict of the rules have no SQL form; tests hold the rules' verdict against NumPy and the run, from what they kept on, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written and read again."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)

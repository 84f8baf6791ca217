"""A corpus pipeline of four stages, each on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next one's docs, and deletes what the stage wrote on its way. All but the last return the columns
of ``documents``; the last adds size, target, taken and copies. The classifier is learnt, which SQL can't express, so
ORACLE_SQL is None; the tests hold the stages against brute force.

In every stage an empty table gives an empty result, texts of any length are read whole, and columns other than doc_id,
text and source pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, mixing, quality, simhash
from marlstone.llm.common import fresh_path
from marlstone.shared import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out third only.

    The text alone decides: rows with equal texts share their fate, null and empty texts count as one text, a null doc_id
    changes nothing. A score of just 0.5 stays.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: few bits apart, or 80 % or more of five-word shingles in common.

    It is that of the smallest doc_id (nulls last), of equal ones that of the smallest text hash, of repeated rows that of
    the smallest hash of all columns. Null and empty texts are copies of each other.
    """
    return simhash.keep_one(docs, similar=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % or more of a benchmark item's five-word shingles go.

    Null and empty texts hold nothing and stay; repeated rows all go or all stay, a null doc_id changes nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often.

    Texts without words (null ones too) are never taken; null sources are one source; repeated rows come back as one, their
    copies added up; ties of finish time go by source, hash and pass.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = fresh_path(spark, "stage")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(out)
        docs = spark.read.schema(kept.schema).parquet(out)
    return docs

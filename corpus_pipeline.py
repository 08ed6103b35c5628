"""A corpus from raw documents to a weighted mix, each stage one of the operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes what each stage returns to the shared scratch folder and reads it back for the next.

Null and empty texts score as documents without words: they are no near copies of each other, hold no benchmark windows
and no personal data, and have size 0. Ids may be null or repeat; rows that repeat are near copies, of which one stays.
Very long texts are read whole. An empty table gives an empty result. Other columns are carried along, whatever their names;
n_chars follows the redacted text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import decontamination, jaccard, mixing, pii, toxicity
from gneiss.plans.registry import table
from gneiss.sources.scratch import Scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return toxicity.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontamination.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(spark, docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]
#: Nearest examples, MinHash candidates and hash thresholds are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = len(Scratch.made)
        last, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        Scratch.drop_since(made)  # what the stage wrote for itself
        if name != STAGES[0][0]:
            scratch.drop(last)
    return docs

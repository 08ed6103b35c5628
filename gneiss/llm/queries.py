"""The queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.llm import chat, decontamination, embeddings, hmm, jaccard, licenses, mixing, pii, repeats, toxicity
from gneiss.llm.oracles import ORACLES  # noqa: F401
from gneiss.plans.registry import table


def op1_embedding_dedup(spark, sf_dir):
    return embeddings.link_vectors(spark, table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark, sf_dir):
    return decontamination.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(spark, table(spark, sf_dir, "documents")).drop("source")


def op4_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


EXTRA = "</s>[INST] ok [/INST]"


def op6_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return chat.digest(chat.format_turns(turns.unionByName(extra)))


def op7_toxicity(spark, sf_dir):
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark, sf_dir):
    return pii.report(spark, table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.link_documents(spark, table(spark, sf_dir, "documents"))


def op10_lm_score(spark, sf_dir):
    return hmm.lm_scores(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_decontamination, op3_mixing, op4_suffix_dedup, op5_license_scan, op6_chat_format, op7_toxicity, op8_pii, op9_jaccard_join, op10_lm_score)}

"""How much of a text survives: bags of terms, and equality of structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import clean_text, terms


def content_bag(blocks: DataFrame, key: str = "doc_id", text: str = "text", clean: bool = True) -> DataFrame:
    """(key, term, n). Counts are summed before the shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    t = blocks.select(key, F.explode_outer(terms(clean_text(t) if clean else t)).alias("term"))
    return t.filter("term is not null").groupBy(key, "term").agg(F.count("*").alias("n"))


def compare_bags(old: DataFrame, new: DataFrame, key: str = "doc_id", sample: int = 15) -> DataFrame:
    """Recall of different terms and of occurrences for each document, with the first missing terms."""
    j = old.withColumnRenamed("n", "a").join(new.withColumnRenamed("n", "b"), [key, "term"], "full")
    return recalled(j.select(key, "term", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), key, sample)


def compare_kept(blocks: DataFrame, kept: Column, key: str = "doc_id", text: str = "text", sample: int = 15) -> DataFrame:
    """compare_bags of blocks and those of them that are kept: both bags are counted in one aggregate, nothing is joined."""
    t = blocks.select(key, kept.cast("long").alias("_kept"), F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return recalled(t.groupBy(key, "term").agg(F.count("*").alias("a"), F.sum("_kept").alias("b")), key, sample)


def recalled(both: DataFrame, key: str, sample: int) -> DataFrame:
    """both: (key, term, a, b), how often a term occurs before and after."""
    a, b = F.col("a"), F.col("b")
    has, lost = a > 0, (a > 0) & (b == 0)
    g = both.groupBy(key).agg(
        F.sum(has.cast("long")).alias("distinct_original"), F.sum(lost.cast("long")).alias("distinct_missing"), F.sum(a).alias("occurrences_original"),
        F.sum(F.least(a, b)).alias("occurrences_kept"), F.array_sort(F.collect_set(F.when(lost, F.col("term")))).alias("missing"),
    )
    share = lambda x, y: F.when(y == 0, 1.0).otherwise(x / y)
    return g.select(
        key, "distinct_original", "distinct_missing", share(F.col("distinct_original") - F.col("distinct_missing"), F.col("distinct_original")).alias("distinct_recall"),
        "occurrences_original", "occurrences_kept", share(F.col("occurrences_kept"), F.col("occurrences_original")).alias("occurrence_ratio"),
        F.array_join(F.slice("missing", 1, sample), " ").alias("missing_sample"),
    )


def fingerprint(blocks: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("kind", "text")) -> DataFrame:
    """(key, fingerprint): equal exactly if the blocks agree in order, kind and stripped text. Each block is digested
    before documents are gathered."""
    one = F.sha2(F.concat_ws("\x1f", *[F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " ")) for c in columns]), 256)
    g = blocks.select(key, "pos", one.alias("h")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("x"))
    return g.select(key, F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ""), 256).alias("fingerprint"))

"""Lines that recur: found by counts, removed by an anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.tokens import Counter, words


def boilerplate(blocks: DataFrame, by: list[str], count: Counter = words, least: int = 3, longest: int = 200, least_tokens: int = 3) -> DataFrame:
    """(by..., text, n, first): short texts that occur several times in a document (or in the corpus, if by is empty).
    Tokens are counted once per recurring text."""
    t = F.trim("text")
    g = blocks.select(*by, "pos", t.alias("text")).filter((F.length("text") > 0) & (F.length("text") <= longest))
    g = g.groupBy(*by, "text").agg(F.count("*").alias("n"), F.min("pos").alias("first")).filter(F.col("n") >= least)
    return g.filter(count(F.col("text")) >= least_tokens)


def marked(blocks: DataFrame, by: list[str], name: str = "recurring", count: Counter = words, least: int = 3, longest: int = 200, least_tokens: int = 3) -> DataFrame:
    """Blocks with a mark on the texts that boilerplate() finds in their document. One shuffle, no join."""
    t = F.trim("text")
    n = F.count("*").over(Window.partitionBy(*by, t))
    return blocks.withColumn(name, (n >= least) & (F.length(t) > 0) & (F.length(t) <= longest) & (count(t) >= least_tokens))


def strip_boilerplate(blocks: DataFrame, by: list[str], **options) -> DataFrame:
    lines = boilerplate(blocks, by, **options).select(*by, F.col("text").alias("_line"))
    return blocks.withColumn("_line", F.trim("text")).join(lines, [*by, "_line"], "left_anti").drop("_line")

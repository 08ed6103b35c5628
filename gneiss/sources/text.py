"""Plain text and delimited text as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraphs(text: Column) -> Column:
    """The stretches between blank lines that aren't blank themselves, white space collapsed."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, kind, text): a paragraph for each stretch between blank lines, white space collapsed. Columns only."""
    d = docs.select(F.col(key), F.posexplode_outer(paragraphs(F.col(text))).alias("pos", "text"))
    return d.filter(F.col("pos").isNotNull()).select(key, "pos", F.lit("para").alias("kind"), "text")


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, kind, text): a paragraph for each line that isn't blank."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n"), lambda p: F.trim(p)), lambda p: p != "")
    d = docs.select(F.col(key), F.posexplode_outer(parts).alias("pos", "text"))
    return d.filter(F.col("pos").isNotNull()).select(key, "pos", F.lit("para").alias("kind"), "text")

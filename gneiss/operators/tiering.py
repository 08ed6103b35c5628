"""Long stretches without sentences (menus, indexes) are set aside and can be fetched again by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import SENTENCE_END
from gneiss.functions.tokens import Counter, words

LEAST_TOKENS = 120
MOST_DENSITY = 0.6
GIST_WORDS = 40


def sentence_density(text: Column, count: Counter = words) -> Column:
    """Sentence ends per hundred tokens."""
    n = count(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(SENTENCE_END)) * F.lit(100.0) / n).otherwise(0.0)


def is_index_like(text: Column, count: Counter = words) -> Column:
    return (count(text) >= LEAST_TOKENS) & (sentence_density(text, count) <= MOST_DENSITY)


def gist(text: Column) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, GIST_WORDS), " ")


def tier(blocks: DataFrame, key: str = "doc_id", count: Counter = words) -> tuple[DataFrame, DataFrame]:
    """The blocks with elisions in place of index-like text (text becomes the gist), and the store (key, eid, text).
    Numbers run over the elided blocks of a document only."""
    marked = blocks.withColumn("_index", (F.col("kind") == "para") & is_index_like(F.col("text"), count))
    index = F.col("_index")
    n = F.row_number().over(Window.partitionBy(key, "_index").orderBy("pos"))
    marked = marked.withColumn("eid", F.when(index, F.concat(F.lit("x"), n.cast("string"))))
    store = marked.filter("_index").select(key, "eid", "pos", "text")
    items = F.size(F.filter(F.split("text", " "), lambda x: F.trim(x) != ""))
    out = marked.select(
        key, "pos", F.when(index, "elision").otherwise(F.col("kind")).alias("kind"), F.when(index, gist(F.col("text"))).otherwise(F.col("text")).alias("text"),
        "eid", F.when(index, count(F.col("text"))).alias("tokens"), F.when(index, items).alias("items"),
    )
    return out, store


def restore(tiered: DataFrame, store: DataFrame, key: str = "doc_id", only: list[str] | None = None) -> DataFrame:
    """Elisions (all, or those named) as paragraphs again."""
    s = store.select(key, "eid", F.col("text").alias("_full"))
    if only is not None:
        s = s.filter(F.col("eid").isin(only))
    j = tiered.join(s, [key, "eid"], "left")
    back = F.col("_full").isNotNull()
    return j.select(key, "pos", F.when(back, "para").otherwise(F.col("kind")).alias("kind"), F.coalesce("_full", "text").alias("text"), F.when(~back, F.col("eid")).alias("eid"))

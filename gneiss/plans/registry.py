"""Where queries and their SQL are kept, and how they read the supplied tables."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Tables of long texts, whose rows cost much more than their shuffle.
WIDE = {"documents", "pages", "conversations"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    """A table as it lies; one of fewer splits than cores (a small file of a single row group) is dealt out first."""
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(cores) if name in WIDE and d.rdd.getNumPartitions() < cores else d

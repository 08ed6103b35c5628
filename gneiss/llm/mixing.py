"""Mixing sources to target weights by hash-threshold histograms.

Each document has a size and a pseudo-random place (the first 60 bits of the MD5 of its id and text). Sizes are summed by source and hash
bucket; running sums give the bucket in which a source's budget ends. Only that bucket is split further, level by level,
until it holds one place. Then a filter on the place decides; documents are never sorted.

Nulls: a null text has size 0; documents without a source form one source, the last. Rows that agree in id and text
share a place; of these as many are taken as the budget leaves, each as a whole. An empty table gives an empty result.
Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.common import RUN, Scratch

WEIGHTS = (5, 2, 1)
CAP = 3.0
LEVEL_BITS = 12
LEVELS = 5
BITS = LEVEL_BITS * LEVELS  # of a place


def targets(scratch: Scratch, totals: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """totals (source, source_size) with each source's target.

    Ranks come from a range partitioning with counts added up over partitions, so that no task holds all sources. The
    share of a unit of weight is raised until capped and uncapped targets add up to the total; only scalars come back.
    """
    part = totals.select("source", "source_size").repartitionByRange(F.col("source").isNull(), F.col("source"))
    part = scratch.write(part.withColumn("p", F.spark_partition_id()))
    counts = scratch.write(part.groupBy("p").agg(F.count("*").alias("n")))  # a row a partition
    offset = counts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    part = part.join(F.broadcast(offset), "p")
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("before")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = scratch.write(part.select("source", "source_size", w.alias("w")))
    most = F.col("source_size") * cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    unit, known = 0.0, None
    while total:
        over = F.col("w") * unit > most
        capped, rest, n = ranked.agg(F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("w"))), F.sum(over.cast("int"))).first()
        if n == known or not rest:
            break
        known, unit = n, (total - (capped or 0.0)) / rest
    return ranked.select("source", "source_size", F.least(F.col("w") * unit, most).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """The size and the place of each document."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(RUN)), F.lit(0)).cast("long")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", size.alias("size"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("place"))


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words the mix takes of each document."""
    scratch = Scratch(spark)
    sizes = scratch.write(sized(docs).withColumn("bucket", F.shiftrightunsigned("place", BITS - LEVEL_BITS)))
    totals = scratch.write(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = scratch.write(
        targets(scratch, totals, weights, cap)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # edge: the bucket of this level in which the rest of the budget ends, and what is still needed from inside it
    edge = goal.select("source", F.lit(0).cast("long").alias("prefix"), "need")
    for level in range(LEVELS):
        shift = BITS - LEVEL_BITS * (level + 1)
        here = sizes.alias("s")
        if level:
            e = F.broadcast(edge) if edge.count() <= 100_000 else edge
            here = here.join(e.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.shiftrightunsigned("s.place", shift + LEVEL_BITS) == F.col("e.prefix")), "left_semi")
        hist = here.groupBy("source", F.shiftrightunsigned("place", shift).alias("prefix")).agg(F.sum("size").alias("n"))
        w = Window.partitionBy("source").orderBy("prefix")
        run = scratch.write(hist.select("source", "prefix", "n", (F.sum("n").over(w) - F.col("n")).alias("before")))
        old = edge.select(F.col("source").alias("s2"), "need")
        edge = scratch.write(
            run.join(old, F.col("source").eqNullSafe(F.col("s2")))
            .filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
            .select("source", "prefix", (F.col("need") - F.col("before")).alias("need"))
        )
        if level == LEVELS - 1:
            last = shift
    # of the rows at the last place, all alike, so many as come nearest to what is needed
    at = goal.join(edge.withColumnRenamed("need", "left").withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    small = F.broadcast(at) if at.count() <= 100_000 else at
    out = sizes.alias("d").join(small.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    code = F.shiftrightunsigned("place", last)
    below = F.coalesce(code < F.col("prefix"), F.col("need") > 0)
    tie = F.coalesce(code == F.col("prefix"), F.lit(False))
    out = out.select("d.doc_id", "d.source", "size", "place", "source_size", "target", "whole", "left", below.alias("below"), tie.alias("tie"))
    ties = out.filter("tie").groupBy("doc_id", "source", "size", "place", "source_size", "target", "whole", "left").agg(F.count("*").alias("m"))
    ties = ties.withColumn("k", F.when(F.col("size") > 0, F.round(F.col("left") / F.col("size"))).otherwise(0))
    ties = ties.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    taken = lambda more: ((F.col("whole") + F.when(more, 1).otherwise(0)) * F.col("size")).cast("long").alias("taken")
    cols = ["doc_id", "source", "size", "source_size", "target"]
    return out.filter("not tie").select(*cols, taken(F.col("below"))).unionByName(ties.select(*cols, taken(F.col("i") <= F.col("k"))))

"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams against every window of the documents.

A window is n consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Documents'
windows are hashed inside the row, only the hashes are exploded, and they meet the broadcast hash table in one pass
without a shuffle; hits are then verified word by word. What is shuffled is a row a document and a row a hit.

Nulls: a null text has no words; a null item_id names no item, but its windows still count as hits. Texts shorter than a
window have none. Rows that agree in id and text get equal results, one each. Repeated items count once per item_id. An
empty benchmark contaminates nothing; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import K, Scratch, keyed, words

N = 10
#: Windows that are broadcast at most (about 0.2 GB); beyond that they are shuffled to the documents' windows.
BROADCAST_WINDOWS = 1_000_000


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """h, gram, len, items: each distinct window with the items that have it."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    w = w.withColumn("g", F.explode_outer(F.expr("transform(sequence(0, size(w) - len), i -> slice(w, i + 1, len))")))
    return w.groupBy(F.xxhash64(F.transform("g", lambda x: F.xxhash64(x))).alias("h"), F.array_join("g", " ").alias("gram"), "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = N) -> tuple[DataFrame, Scratch]:
    """A row for each distinct document: its id, n_words, copies, spans (start, len of hit windows) and the items' ids."""
    scratch = Scratch(spark)
    grams = scratch.write(benchmark_windows(benchmark, n))
    stats = grams.groupBy("len").agg(F.count("*").alias("n")).orderBy("len").collect()  # n rows at most
    lens = [r.len for r in stats]
    d = keyed(docs).withColumn("w", words(F.col("text"))).drop("text")
    # one array a document: a null for the document itself, then its windows of each length. Words are hashed once and
    # windows made from these hashes by their places; slices would copy the whole array for each window
    hashes = [f"if(size(x) >= {k}, transform(sequence(0, size(x) - {k}), i -> xxhash64({', '.join(f'x[i + {j}]' for j in range(k))})), array())" for k in lens]
    hashes = f"transform(array(transform(w, y -> xxhash64(y))), x -> concat(array(cast(null as bigint)), {', '.join(hashes)}))[0]" if lens else "array(cast(null as bigint))"
    small = grams.select(F.col("h").alias("gh"), "gram", "len", "items")
    counted = d.select("doc_id", *K, "w", F.size("w").alias("n_words"))
    if sum(r.n for r in stats) <= BROADCAST_WINDOWS:
        d = counted.withColumn("hs", F.expr(hashes)).select("doc_id", *K, "w", "n_words", F.posexplode_outer("hs").alias("pos", "h"))
        d = d.join(F.broadcast(small), F.col("h") == F.col("gh"), "left").filter("pos = 0 or gh is not null")
    else:  # only keys, places and hashes are shuffled; words meet the windows found
        places = d.select(*K, F.posexplode(F.expr(hashes)).alias("pos", "h")).filter("pos > 0")
        found = scratch.write(places.join(small, F.col("h") == F.col("gh")).select(*K, "pos", "gh", "gram", "len", "items").dropDuplicates([*K, "pos", "gram"]))
        own = counted.select("*", F.lit(0).alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in (("gh", "bigint"), ("gram", "string"), ("len", "int"), ("items", "array<string>"))])
        d = counted.join(found, K).unionByName(own)
    start, before = F.lit(None).cast("int"), F.lit(0)
    for k in lens:  # pos counts through the lengths in turn
        start = F.when(F.col("len") == k, F.col("pos") - before).otherwise(start)
        before = before + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    d = d.withColumn("start", start)
    d = d.filter("pos = 0 or array_join(slice(w, start, len), ' ') = gram")
    out = d.groupBy("doc_id", *K).agg(
        F.sum((F.col("pos") == 0).cast("long")).alias("copies"), F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("pos") > 0, F.struct("start", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return out, scratch


def covered(spans: str) -> str:
    """SQL for the number of words under sorted spans (start, len)."""
    return (
        f"aggregate({spans}, named_struct('e', 0, 'n', 0L), (a, s) -> named_struct('e', greatest(a.e, s.start + s.len), "
        "'n', a.n + greatest(0, s.start + s.len - greatest(a.e, s.start))), a -> a.n)"
    )


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    out, _ = hits(spark, docs, benchmark, n)
    out = out.withColumn("n_hit", F.expr(covered("spans"))).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    out, scratch = hits(spark, docs, benchmark, n)
    bad = scratch.write(out.filter(F.size("spans") > 0).select(*K))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k = [F.xxhash64(F.col("doc_id"), text), F.hash(text, F.col("doc_id"))]
    return docs.join(bad, (k[0] == bad["_k1"]) & (k[1] == bad["_k2"]), "left_anti")

"""What the operators of this subpackage share: row keys, words and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.sources.scratch import Scratch, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words in the sense of the word shingles and windows: digits, letters a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in the sense of sizes and language models: runs without white space.
RUN = r"[^\x20\x09-\x0D]+"
K = ["_k1", "_k2"]
EDGES_A_FILE = 200_000


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text (null: empty) and a row key made from both; rows that agree in both share it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").alias("doc_id"), text.alias("text"),
        F.xxhash64(F.col("doc_id"), text).alias("_k1"), F.hash(text, F.col("doc_id")).alias("_k2"), *columns,
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each changed until no column of the frame is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(lower_ascii(c), F.lit(WORD), F.lit(0))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): each node with the smallest node that it reaches, as (node, component).

    Alternates large-star and small-star steps (each node's neighbours are linked to its smallest one), so that the
    number of rounds grows with the logarithm of the size. Minima are aggregated before they are shuffled, both sides
    of each join come from written tables, so that a hub's rows can be split. Self-links may name lone nodes. Tables of
    the rounds have a file for each EDGES_A_FILE edges, as there are rarely more of them than at the start.
    """
    first = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # count and a digest that doesn't depend on the order: equal exactly if nothing changes any more
    state = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    cur, before = first, state(first)
    files = before[0] // EDGES_A_FILE + 1
    write = lambda df: scratch.write(df.coalesce(files))
    for _ in range(max_rounds):
        # large star: larger neighbours go to the smallest of all neighbours and the node itself
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = write(
            both.filter("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.filter("u = m").select("u", F.col("m").alias("v"))).distinct()
        )
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        low2 = write(large.groupBy("u").agg(F.min("v").alias("m")))
        new = write(
            large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        )
        now = state(new)
        scratch.drop(cur, low, large, low2)
        cur = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return write(cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"))

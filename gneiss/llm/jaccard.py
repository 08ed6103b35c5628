"""Near-duplicate documents: banded MinHash LSH and exact verification.

Texts with the same words form a class, which is handled once. Each class has a signature in each of TREES bands, of as
many minima as the target recall allows at the threshold (at most DEPTH; it doesn't depend on the data); classes that share
a band are candidates. This is not an LSH forest: no signatures are sorted and no prefixes shortened by the data.
Candidates are joined to clusters by star edges, not pairs. In each cluster the sets of shingles are then compared
exactly, tile by tile: large clusters are cut into tiles of bounded size, and each pair of tiles is a group of its own.
A group returns, for each class, its number of links and one edge of a spanning forest; so no hub or clique leaves a task
as pairs. Shingles are compared as 64-bit hashes.

A text with fewer than five words has one shingle, of all of them; a text without words (or null) links with nothing, not
even with its like. Rows that repeat are copies of each other. Ids may repeat or be null. An empty table gives an empty
result; other columns are ignored by link_documents and kept by keep_one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import tokens as tk
from gneiss.llm.common import K, Scratch, components, keyed, unused

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 10
RECALL = 0.9995
#: Classes and shingles of a tile.
TILE = 512
TILE_SHINGLES = 400_000


def recall(depth: int, trees: int, threshold: float) -> float:
    """The chance that a pair at the threshold shares a prefix of this depth in one of the trees at least."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(trees: int, depth: int, threshold: float, target: float) -> int:
    """The longest bands, of this depth at most, that meet the target recall."""
    while depth > 1 and recall(depth, trees, threshold) < target:
        depth -= 1
    return depth


def _multipliers(n: int) -> np.ndarray:
    return (tk.mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def prefixes(sh: np.ndarray, at: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each text the hashes of its signature prefixes; texts without shingles have zeros."""
    out = np.zeros((len(at) - 1, trees), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    seg = at[full]
    hi = (sh >> np.uint64(32)).astype(np.uint32)
    lo = sh.astype(np.uint32)
    a = _multipliers(trees * depth)
    # in stretches that stay in the cache
    cut = 0
    while cut < len(full):
        end = max(cut + 1, int(np.searchsorted(seg, seg[cut] + 32768)))
        s, e = seg[cut], at[full[min(end, len(full)) - 1] + 1]
        x, y, r = hi[s:e], lo[s:e], seg[cut:end] - s
        for t in range(trees):
            key = np.full(len(r), t + 1, np.uint64)
            for d in range(depth):
                k = t * depth + d
                v = (x ^ (y >> np.uint32(k % 7))) * a[k]
                key = tk.mix(key ^ np.minimum.reduceat(v, r).astype(np.uint64))
            out[full[cut:end], t] = key
        cut = end
    return out


def signature_batches(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for i, j, b, off in tk.chunks(text):
                low = tk.LOWERED[b]
                starts, stops, first = tk.word_stretches(low, off, tk.WORD_BYTE)
                h = tk.stretch_hash(tk.prefix_hash(low), starts, stops)
                sh, at = tk.shingles(h, first, WORDS)
                keys = prefixes(sh, at, trees, depth)
                # the words with one blank after each are what a class agrees in
                keep = tk.WORD_BYTE[low]
                blank = stops[stops < len(low)]
                norm = low.copy()
                norm[blank[~keep[blank]]] = 32
                keep[blank] = True
                norm, cut = norm[keep], np.concatenate(([0], np.cumsum(keep)))[off]
                raw = norm.tobytes()
                cls = [hashlib.blake2b(raw[cut[k] : cut[k + 1]].strip(b" "), digest_size=16).digest() if at[k + 1] > at[k] else None for k in range(j - i)]
                rows = batch.slice(i, j - i)
                flat = pa.array(keys.astype(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("_k1"), rows.column("_k2"), pa.array(cls, pa.binary()), pa.array(np.diff(at)), pa.ListArray.from_arrays(np.arange(0, (j - i + 1) * trees, trees, dtype=np.int32), flat)],
                    ["doc_id", "_k1", "_k2", "cls", "n", "keys"],
                )

    return run


def linked(cls: list[bytes], mult: np.ndarray, side: np.ndarray, column: pa.Array, threshold: float):
    """For each class with links in a group: class, root, links. Where there are two sides, only pairs across count."""
    sets = []
    for _, _, b, off in tk.chunks(column):
        sh, at = tk.shingles(*tk.word_hashes(b, off), WORDS)
        sets += [np.unique(sh[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
    size = np.array([len(s) for s in sets])
    # decided by integers, so that ties at the threshold count at any length
    above, below = Fraction(str(threshold)).as_integer_ratio()
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        u, v = (np.array([0]), np.array([1])) if both * (above + below) >= above * size.sum() and side[0] != side[1] | (side.max() == 0) else (np.zeros(0, int), np.zeros(0, int))
    else:
        row = np.repeat(np.arange(len(sets)), size)
        _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df > 1
        name = np.cumsum(shared) - 1
        take = shared[col]
        row, col = row[take], name[col[take]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(sets), len(sets)), np.int64)
        wide = 8192
        for c in range(0, int(shared.sum()), wide):
            s, e = np.searchsorted(col, [c, c + wide])
            m = np.zeros((len(sets), min(wide, int(shared.sum()) - c)), np.float32)
            m[row[s:e], col[s:e] - c] = 1
            both += (m @ m.T).astype(np.int64)
        hit = np.triu(both * (above + below) >= above * (size[:, None] + size[None, :]), 1)
        if side.max():
            hit &= side[:, None] != side[None, :]
        u, v = np.nonzero(hit)
    links = np.bincount(u, mult[v], len(sets)) + np.bincount(v, mult[u], len(sets))
    root = tk.forest(len(sets), u, v)
    return [(cls[k], cls[root[k]], int(links[k])) for k in np.flatnonzero(links)]


def verify_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for (_, a, b), t in tk.groups(batches, 3):
            cls = t.column("cls").combine_chunks() if t.column("cls").num_chunks != 1 else t.column("cls").chunk(0)
            names = cls.to_pylist()
            _, first = np.unique(np.array(names, dtype=object), return_index=True)
            if len(first) < 2:
                continue
            t = t.take(pa.array(np.sort(first)))
            tile = t.column("tile").to_numpy()
            if a != b and (tile == tile[0]).all():
                continue  # links inside a tile are counted in its own group
            out += linked(t.column("cls").to_pylist(), t.column("mult").to_numpy(), (tile != a).astype(int) if a != b else np.zeros(len(tile), int), t.column("text").combine_chunks() if t.column("text").num_chunks > 1 else t.column("text").chunk(0), threshold)
            if len(out) > 10_000:
                yield emit(out)
                out = []
        yield emit(out)

    def emit(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["cls", "root", "links"])

    return run


def link_classes(scratch: Scratch, docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """A row for each document (doc_id, row key, cls) and one for each class (cls, mult, links, group, first)."""
    depth = prefix_depth(trees, DEPTH, threshold, target)
    rows = keyed(docs)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sig = scratch.write(rows.mapInArrow(signature_batches(trees, depth), f"doc_id {id_type}, _k1 bigint, _k2 int, cls binary, n bigint, keys array<bigint>"))
    least = F.min(F.struct("doc_id", *K))
    classes = scratch.write(sig.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("mult"), least.alias("first"), F.max("n").alias("n")))
    # prefixes that several classes share; a class is named by eight bytes of its digest, which may only join clusters
    lead = F.conv(F.hex(F.substring("cls", 1, 7)), 16, 10).cast("long")
    keys = sig.filter("cls is not null").select(lead.alias("c"), F.explode("keys").alias("key"))
    shared = scratch.write(keys.groupBy("key").agg(F.min("c").alias("v"), F.max("c").alias("z")).filter("v <> z").select("key", "v"))
    # joins that shuffle at scale are written as such, so that small inputs show the same plan
    edges = keys.join(shared.hint("merge"), "key").select(F.col("c").alias("u"), "v").distinct()
    clusters = components(scratch, edges)
    cand = scratch.write(classes.withColumn("c", lead).join(clusters, F.col("c") == F.col("node")).select("cls", "mult", "n", "first", F.col("component").alias("cluster")))
    tiles = cand.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    cand = cand.join(scratch.write(tiles), "cluster").withColumn("tile", F.expr("cast(pmod(xxhash64(cls), tiles) as int)"))
    cand = scratch.write(cand.select("cls", "mult", "cluster", "tile", "tiles", F.col("first._k1").alias("_k1"), F.col("first._k2").alias("_k2")))
    text = rows.select(*K, "text").join(cand.hint("merge"), K)
    text = text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = text.select("cluster", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "cls", "mult", "text")
    pairs = pairs.repartition(n, "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    links = scratch.write(pairs.mapInArrow(verify_batches(threshold), "cls binary, root binary, links bigint"))
    comp = components(scratch, links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    total = links.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(total, "cls", "left").join(comp, F.col("cls") == F.col("node"), "left")
    known = scratch.write(known.select("cls", "mult", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("group")))
    low = known.groupBy("group").agg(F.min("first").alias("lead"))
    return sig.select("doc_id", *K, "cls"), scratch.write(known.join(scratch.write(low), "group").select("cls", "mult", "links", "lead"))


def link_documents(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_links (other documents with a similarity of the threshold at least), component_id (the smallest doc_id
    reached over links), kept (whether the row stands for its component), for each row of docs."""
    scratch = Scratch(spark)
    rows, classes = link_classes(scratch, docs, threshold)
    out = rows.join(classes, "cls", "left")
    return out.select(
        "doc_id", F.coalesce(F.col("links") + F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("component_id"),
        (F.col("cls").isNull() | (F.struct("doc_id", *K) == F.col("lead"))).alias("kept"),
    )


def keep_one(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each component, with all columns; texts without words stay."""
    scratch = Scratch(spark)
    p1, p2, again_ = unused(docs, "p1", "p2", "again")
    rows, classes = link_classes(scratch, docs, threshold)
    lead = classes.select(F.col("lead._k1").alias(p1), F.col("lead._k2").alias(p2)).distinct().withColumn("one", F.lit(1))
    copies = rows.groupBy(F.col("_k1").alias(p1), F.col("_k2").alias(p2)).agg(F.count("*").alias("m"), F.max(F.col("cls").isNull().cast("int")).alias("none"))
    stay = copies.join(lead, [p1, p2], "left").filter("one is not null or none = 1").select(p1, p2, ((F.col("m") > 1) & (F.col("none") == 0)).alias(again_))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.join(scratch.write(stay).hint("merge"), (F.xxhash64(F.col("doc_id"), text) == F.col(p1)) & (F.hash(text, F.col("doc_id")) == F.col(p2)))
    return d.filter(~F.col(again_)).unionByName(d.filter(again_).dropDuplicates([p1, p2])).select(*[F.col(f"`{c}`") for c in docs.columns])

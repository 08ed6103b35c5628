"""Exact substring dedup by suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else. Texts that are equal form a class, of
which one is looked at; a class of several, if long enough, goes as a whole. In each text anchors are chosen by winnowing:
in any LENGTH bytes the ANCHOR-byte string with the least hash. Two equal strings hold the same anchor at the same place,
so only texts around anchors that occur twice are looked at, LENGTH - ANCHOR bytes on each side (contexts). Contexts that
occur twice as a whole are repeats as they are. Where an anchor has several contexts, these are sorted: suffixes by
two-stage sorting, common prefixes of neighbours, and repeats where two contexts agree in LENGTH bytes at the same place
relative to the anchor. Contexts are bundled, so that a task holds BUNDLE bytes. An anchor with more than CONTEXTS
different contexts is not sorted in one task: its windows are counted by their digests in a shuffle, which finds the same.

Passages that recur are mostly longer than LENGTH bytes, but need not be. n_passages counts the RUN-word strings of a
document, chosen by winnowing over words, that another document has: a document that shares PASSAGE words or more with
another has at least one, one that has any shares RUN words. It says what recurs and removes nothing.

A null text is empty. Rows that agree in id and text get equal results. An empty table gives an empty result; other
columns are ignored. A text must fit in a task's memory; the whole text is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import suffixes as sx
from gneiss.llm import tokens as tk
from gneiss.llm.common import K, Scratch, keyed

LENGTH = 400
ANCHOR = 200
SIDE = LENGTH - ANCHOR
CONTEXTS = 4000
BUNDLE = 2_000_000
#: Contexts that a task holds at once where it makes or digests them.
SLICE = 1000
#: Words of a passage that is found in any other document, and of the runs by which it is found.
PASSAGE = 51
RUN = 40


def winnowed(h: np.ndarray, off: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Places of the anchors of texts side by side, which begin at off: of each `length` units inside a text the `anchor`
    units with the least hash, the last of equals. h: the hash of `anchor` units at each place."""
    n = int(off[-1]) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w = length - anchor + 1
    pad = -len(key) % w
    key = np.concatenate((key, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(key, 1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    inside = np.zeros(int(off[-1]) + 1, np.int32)  # where `length` units of one text start
    long = np.diff(off) >= length
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - length + 1, -1)
    return np.unique(np.uint64(0xFFFFFFFF) - (least[np.cumsum(inside)[:n] > 0] & np.uint64(0xFFFFFFFF))).astype(np.int64)


def anchors(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts side by side."""
    if len(b) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(b) - ANCHOR + 1)
    h = tk.stretch_hash(tk.prefix_hash(b), at, at + ANCHOR)
    chosen = winnowed(h, off, LENGTH, ANCHOR)
    return chosen, h[chosen]


def passages(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of RUN words chosen from each PASSAGE words inside a text, and the first of each text."""
    words, first = tk.word_hashes(b, off)
    if len(words) < PASSAGE:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    power, inverse = tk.powers(len(words) + 1)
    c = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=c[1:])
    h = tk.mix((c[RUN:] - c[:-RUN]) * inverse[: len(words) - RUN + 1])
    at = winnowed(h, first, PASSAGE, RUN)
    return h[at], np.searchsorted(at, first)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, b, off in tk.chunks(batch.column("text")):
            at, h = anchors(b, off)
            shared, to = passages(b, off)
            cut = np.searchsorted(at, off).astype(np.int32)
            raw, o = b.tobytes(), off.tolist()
            texts = [raw[p:q] for p, q in zip(o, o[1:], strict=False)]
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("_k1"), rows.column("_k2"), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), pa.array(np.diff(off)), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.ListArray.from_arrays(cut, pa.array(h.astype(np.int64))), pa.ListArray.from_arrays(cut, pa.array((at - np.repeat(off[:-1], np.diff(cut))).astype(np.int32))),
                 pa.ListArray.from_arrays(to.astype(np.int32), pa.array(shared.astype(np.int64)))],
                ["doc_id", "_k1", "_k2", "cls", "n", "sha", "h", "at", "runs"],
            )


def contexts(batch: pa.RecordBatch, *more: str) -> Iterator[list[tuple]]:
    """Slices of (row, hash, place, bytes before the anchor, context, ...), with values of further array columns."""
    out: list[tuple] = []
    for r in range(batch.num_rows):
        raw = batch.column("text")[r].as_py().encode()
        for h, at, *x in zip(*(batch.column(c)[r].as_py() for c in ("h", "at", *more)), strict=True):
            left = min(at, SIDE)
            out.append((r, h, at, left, raw[at - left : at + ANCHOR + SIDE], *x))
            if len(out) == SLICE:
                yield out
                out = []
    if out:
        yield out


def context_digest(before: int, context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16, salt=before.to_bytes(2, "little")).digest()


def occurrence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for got in contexts(batch):
            rows, h, at, before, context = zip(*got, strict=True)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k1").take(take), batch.column("_k2").take(take), pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(before, pa.int32()), pa.array([len(c) for c in context], pa.int32()), pa.array(map(context_digest, before, context), pa.binary())],
                ["_k1", "_k2", "h", "at", "before", "size", "ctx"],
            )


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for got in contexts(batch, "crowd"):
            _, h, _, before, context, crowd = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(map(context_digest, before, context), pa.binary()), pa.array(before, pa.int32()), pa.array(context, pa.binary()), pa.array(crowd, pa.int64())],
                ["h", "ctx", "before", "bytes", "crowd"],
            )


def sort_bundle(group: np.ndarray, before: np.ndarray, strings: list[bytes]) -> list[tuple[list[int], list[int]]]:
    """For each context the stretches, relative to its anchor, that repeat in another context of its group."""
    size = np.array([len(s) for s in strings])
    raw = b"\0".join(strings) + b"\0"
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    order = sx.suffix_order(raw, begin, begin + size, begin + size - LENGTH, LENGTH)
    run = np.concatenate(([0], np.cumsum(~sx.common(raw, order, LENGTH)))) if len(order) else np.zeros(0, np.int64)
    of = np.searchsorted(begin, order, "right") - 1
    place = order - begin[of] - before[of] + SIDE
    by = np.lexsort((place, group[of], run))
    key = np.stack((run[by], group[of][by], place[by]))
    same = (key[:, 1:] == key[:, :-1]).all(0)
    twice = np.zeros(len(order), bool)
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    starts = np.sort(order[twice])
    return stretches(starts, begin, before, len(strings))


def stretches(starts: np.ndarray, begin: np.ndarray, before: np.ndarray, n: int) -> list[tuple[list[int], list[int]]]:
    of = np.searchsorted(begin, starts, "right") - 1
    out: list = [([], []) for _ in range(n)]
    for k, s in zip(of.tolist(), (starts - begin[of] - before[of]).tolist(), strict=True):
        a, z = out[k]
        if z and s <= z[-1]:
            z[-1] = s + LENGTH
        else:
            a.append(s)
            z.append(s + LENGTH)
    return out


def bundle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0
    for _, t in tk.groups(batches, 1):
        held.append(t)
        size += t.column("bytes").nbytes
        if size > BUNDLE:
            yield bundle(held)
            held, size = [], 0
    if held:
        yield bundle(held)


def bundle(held: list[pa.Table]) -> pa.RecordBatch:
    t = pa.concat_tables(held).combine_chunks()
    got = sort_bundle(t.column("h").to_numpy(), t.column("before").to_numpy().astype(np.int64), t.column("bytes").to_pylist())
    keep = [k for k, g in enumerate(got) if g[0]]
    take = pa.array(keep, pa.int64())
    return pa.RecordBatch.from_arrays([t.column("h").combine_chunks().take(take), t.column("ctx").combine_chunks().take(take), pa.array([got[k][0] for k in keep], pa.list_(pa.int32())), pa.array([got[k][1] for k in keep], pa.list_(pa.int32()))], ["h", "ctx", "a", "z"])


def window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of contexts of crowded anchors by their digests."""
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE // 10):
            batch = whole.slice(k, SLICE // 10)
            rows, place, digest = [], [], []
            for r, (left, c) in enumerate(zip(batch.column("before").to_pylist(), batch.column("bytes").to_pylist(), strict=True)):
                for s in range(len(c) - LENGTH + 1):
                    rows.append(r)
                    place.append(s - left)
                    digest.append(hashlib.blake2b(c[s : s + LENGTH], digest_size=16).digest())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("h").take(take), batch.column("ctx").take(take), pa.array(place, pa.int32()), pa.array(digest, pa.binary())], ["h", "ctx", "a", "w"])


#: SQL: the stretches of sorted starts s, those that touch as one.
MERGED = f"""aggregate(s, cast(array() as array<struct<a:int,z:int>>), (o, x) ->
    if(size(o) > 0 and x <= element_at(o, -1).z, concat(slice(o, 1, size(o) - 1), array(named_struct('a', element_at(o, -1).a, 'z', x + {LENGTH}))),
       concat(o, array(named_struct('a', x, 'z', x + {LENGTH})))))"""


def kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, sha = [], [], []
        for text, got in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.encode()
            out, at, n, k = hashlib.sha256(), 0, 0, 0
            for x in got:  # in order of their starts
                a, z = x["a"], x["z"]
                if a > at or not k:
                    out.update(raw[at:a])
                    k += 1
                    n += z - a
                    at = z
                elif z > at:
                    n += z - at
                    at = z
            out.update(raw[at:])
            removed.append(n)
            spans.append(k)
            sha.append(out.digest())
        yield pa.RecordBatch.from_arrays([batch.column("_k1"), batch.column("_k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.binary())], ["_k1", "_k2", "n_removed", "n_spans", "kept"])


def shared_runs(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """_k1, _k2, n_passages: how many of a document's runs another document has. A run that many have is one row for each
    partition before it is shuffled; keys tell documents apart."""
    runs = texts.select(*K, F.explode(F.array_distinct("runs")).alias("run"))
    key = F.struct(*K)
    again = runs.groupBy("run").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select("run")
    return runs.join(scratch.write(again), "run").dropDuplicates([*K, "run"]).groupBy(*K).agg(F.count("*").alias("n_passages"))


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages for each row of docs."""
    scratch = Scratch(spark)
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = scratch.write(rows.mapInArrow(text_batches, f"doc_id {kind}, _k1 bigint, _k2 int, cls binary, n bigint, sha binary, h array<bigint>, at array<int>, runs array<bigint>"))
    classes = scratch.write(texts.filter(F.col("n") >= LENGTH).groupBy("cls").agg(F.count("*").alias("mult"), F.min(F.struct(*K)).alias("one")))
    one = classes.select(F.col("one._k1").alias("_k1"), F.col("one._k2").alias("_k2"), (F.col("mult") > 1).alias("whole"))
    found = texts.select(*K, "h", "at").join(one, K).select(*K, "whole", F.explode(F.arrays_zip("h", "at")).alias("x")).select(*K, "whole", "x.*")
    found = scratch.write(found)
    again = scratch.write(found.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"))
    again = scratch.write(found.join(again, "h").groupBy(*K, "whole").agg(F.array_sort(F.collect_set(F.struct("at", "h"))).alias("x")).select(*K, "whole", F.col("x.h").alias("h"), F.col("x.at").alias("at")))
    scratch.drop(found)
    active = scratch.write(rows.select(*K, "text").join(again, K))  # rows that repeat come again; their class goes as a whole
    scratch.drop(again)
    seen = scratch.write(active.mapInArrow(occurrence_batches, "_k1 bigint, _k2 int, h bigint, at int, before int, size int, ctx binary"))
    different = scratch.write(seen.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.min(F.struct(*K, "at")).alias("one"), F.min("before").alias("before"), F.min("size").alias("size")))
    crowds = scratch.write(different.groupBy("h").agg(F.count("*").alias("crowd")).filter("crowd > 1"))
    mixed = different.join(crowds, "h").filter(F.col("size") >= LENGTH)
    mixed = mixed.groupBy(F.col("one._k1").alias("_k1"), F.col("one._k2").alias("_k2")).agg(F.array_sort(F.collect_set(F.struct(F.col("one.at").alias("at"), "h", "crowd"))).alias("x"))
    mixed = active.select(*K, "text").join(mixed, K).dropDuplicates(K).select("text", F.col("x.h").alias("h"), F.col("x.at").alias("at"), F.col("x.crowd").alias("crowd"))
    mixed = scratch.write(mixed.mapInArrow(context_batches, "h bigint, ctx binary, before int, bytes binary, crowd bigint"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = mixed.filter(F.col("crowd") <= CONTEXTS).select("h", "ctx", "before", "bytes").repartition(n, "h").sortWithinPartitions("h")
    few = few.mapInArrow(bundle_batches, "h bigint, ctx binary, a array<int>, z array<int>")
    few = few.select("h", "ctx", F.explode(F.arrays_zip("a", "z")).alias("x")).select("h", "ctx", "x.a", "x.z")
    many = mixed.filter(F.col("crowd") > CONTEXTS).mapInArrow(window_batches, "h bigint, ctx binary, a int, w binary")
    many = scratch.write(many)
    twice = scratch.write(many.groupBy("h", "a", "w").agg(F.count("*").alias("c")).filter("c > 1").select("h", "a", "w"))
    many = many.join(twice, ["h", "a", "w"]).groupBy("h", "ctx").agg(F.array_sort(F.collect_set("a")).alias("s"))
    many = many.select("h", "ctx", F.explode(F.expr(MERGED)).alias("x")).select("h", "ctx", "x.a", "x.z")
    full = different.filter((F.col("c") > 1) & (F.col("size") >= LENGTH)).select("h", "ctx", (-F.col("before")).alias("a"), (F.col("size") - F.col("before")).alias("z"))
    repeats = scratch.write(few.unionByName(many).unionByName(full))
    spans = seen.join(repeats, ["h", "ctx"]).groupBy(*K).agg(F.array_sort(F.collect_set(F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("z")).alias("z")))).alias("spans"))
    kept = active.filter("not whole").select(*K, "text").join(spans, K).mapInArrow(kept_batches, "_k1 bigint, _k2 int, n_removed bigint, n_spans bigint, kept binary")
    out = texts.select("doc_id", *K, "cls", "n", "sha").join(classes.select("cls", "mult"), "cls", "left").join(scratch.write(kept), K, "left")
    out = out.join(scratch.write(shared_runs(scratch, texts)), K, "left")
    whole = F.coalesce(F.col("mult") > 1, F.lit(False))
    return out.select(
        "doc_id", F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
    )

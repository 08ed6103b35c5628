"""Language-model scores: a hidden Markov model over words, trained by Baum-Welch.

All training documents are counted. The WORDS most frequent tokens emit as themselves; every other token emits as one of
ENDINGS classes, by its last two bytes, times its share of the class, in which one unknown token has half a count. So the
model gives every text a proper probability. Each round of Baum-Welch runs over all training documents: partitions send
expected counts, a row for each symbol, which are added up in a shuffle; the new parameters are broadcast. A text's score is
the exact scaled forward likelihood over its whole sequence, however long; training counts whole sequences too, and keeps
forward values of SEGMENT tokens at a time, so that its memory is bounded.

Counts of tokens: the most frequent (FREQUENT at most) are broadcast; the others meet their documents in a join.

A null text is empty and has its end as its only token. Rows that repeat are counted and scored one by one. A null doc_id
counts as empty text when rows are held out. Without training documents every base score is 0. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import tokens as tk
from gneiss.llm.common import K, Scratch, keyed, remainder

STATES = 8
WORDS = 4000
ENDINGS = 64
FREQUENT = 400_000
ROUNDS = 4
SEGMENT = 1024
#: Tokens that are worked on at once.
STRETCH = 300_000
#: Added to each expected count.
SMOOTH = 0.05
HELD = 4_000_000


def hashed(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending class of each token, and the first token of each text; ends are left out."""
    low = tk.LOWERED[b]
    starts, stops, first = tk.word_stretches(low, off, tk.RUN_BYTE)
    h = tk.stretch_hash(tk.prefix_hash(low), starts, stops)
    last = low[stops - 1].astype(np.int64)
    before = np.where(stops - starts > 1, low[np.maximum(stops - 2, 0)], 0).astype(np.int64)
    return h, (before * 131 + last * 7) % ENDINGS, first


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, ending, c: tokens of training texts and their counts; documents' ends are counted elsewhere."""
    held: list[tuple] = []

    def merged() -> tuple:
        h, g, c = (np.concatenate(x) for x in zip(*held, strict=True))
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        return u, g[at], np.bincount(inv, c, len(u)).astype(np.int64)

    for batch in batches:
        batch = batch.filter(pa.array(~batch.column("held_out").to_numpy(zero_copy_only=False)))
        for _, _, b, off in tk.chunks(batch.column("text")):
            h, g, _ = hashed(b, off)
            u, at, c = np.unique(h, return_index=True, return_counts=True)
            held.append((u, g[at], c))
            if sum(len(x[0]) for x in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield emit(held.pop())
    if held:
        yield emit(merged())


def emit(x: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0].astype(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["h", "ending", "c"])


def encode_batches(shared):
    """Each text as codes (0: end, then words, then endings), sums of log10(c + 0.5) over its frequent tokens, and its rare
    tokens with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, code_of = shared.value
        for batch in batches:
            for i, j, b, off in tk.chunks(batch.column("text")):
                h, g, first = hashed(b, off)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                word = np.where(hit, code_of[at], 0) if len(known) else np.zeros(len(h), np.int64)
                code = np.where(word > 0, word, 1 + WORDS + g).astype(np.uint16)
                x = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(h))
                sums = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[first])  # noqa: E731, B023
                doc = np.repeat(np.arange(j - i), np.diff(first))
                rare = ~hit
                order = np.lexsort((h[rare], doc[rare]))
                rh, rd = h[rare][order], doc[rare][order]
                new = np.ones(len(rh), bool)
                new[1:] = (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])
                pos = np.flatnonzero(new)
                cut = np.searchsorted(rd[pos], np.arange(j - i + 1)).astype(np.int32)
                raw = code.tobytes()
                codes = [raw[2 * p : 2 * q] + b"\0\0" for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("_k1"), rows.column("_k2"), rows.column("held_out"), pa.array(codes, pa.binary()), pa.array(np.diff(first).astype(np.int64)),
                     pa.array(sums(hit).astype(np.int64)), pa.array(sums(x)), pa.array(sums(np.where(word > 0, x, 0.0))),
                     pa.ListArray.from_arrays(cut, pa.array(rh[pos].astype(np.int64))), pa.ListArray.from_arrays(cut, pa.array(np.diff(np.append(pos, len(rh)))))],
                    ["doc_id", "_k1", "_k2", "held_out", "codes", "n", "n_frequent", "s_frequent", "s_words", "rare", "tf"],
                )

    return run


def stretches(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences, longest first, in stretches of about STRETCH tokens."""
    order = np.argsort(-lengths, kind="stable")
    total = np.cumsum(lengths[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + STRETCH)))
        yield order[i:j]
        i = j


def laid(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences (longest first) side by side: the codes by time, then sequence, and the first place of each time."""
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), "right")
    at = np.concatenate(([0], np.cumsum(active)))
    time = np.repeat(np.arange(len(active)), active)
    seq = np.arange(at[-1]) - at[time]
    return values[start[seq] + time], at


def forward(codes: np.ndarray, at: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence, by scaled forward values."""
    n = int(at[1]) if len(at) > 1 else 0
    like, x = np.zeros(n), np.broadcast_to(pi, (n, len(pi)))
    for t in range(len(at) - 1):
        s, e = at[t], at[t + 1]
        x = (x[: e - s] @ a if t else x) * b[codes[s:e]]
        c = x.sum(1)
        x = x / c[:, None]
        like[: e - s] += np.log(c)
    return like


def expected(codes: np.ndarray, at: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray, block: int | None = None) -> tuple:
    """Expected first states, transitions and emissions, and the log likelihood, of whole sequences.

    The forward pass keeps its values where a block of so many times begins; the backward pass makes those inside a block
    again from there, so that the memory follows the block and not the length.
    """
    block = block or SEGMENT
    times, k = len(at) - 1, len(pi)
    n = int(at[1]) if times else 0
    like, x = np.zeros(n), np.broadcast_to(pi, (n, k))
    marks = []
    for t in range(times):
        if t % block == 0:
            marks.append(x)
        s, e = at[t], at[t + 1]
        x = (x[: e - s] @ a if t else x) * b[codes[s:e]]
        c = x.sum(1)
        x = x / c[:, None]
        like[: e - s] += np.log(c)
    first, moves, out = np.zeros(k), np.zeros((k, k)), np.zeros((len(b), k))
    ahead = np.zeros((0, k))  # emissions times backward values at the time after the block
    for m in range(len(marks) - 1, -1, -1):
        t0, t1 = m * block, min((m + 1) * block, times)
        begin, end = at[t0], at[t1]
        alpha, scale, x = np.empty((end - begin, k)), np.empty(end - begin), marks[m]
        for t in range(t0, t1):
            s, e = at[t], at[t + 1]
            x = (x[: e - s] @ a if t else x) * b[codes[s:e]]
            c = x.sum(1)
            x = x / c[:, None]
            alpha[s - begin : e - begin], scale[s - begin : e - begin] = x, c
        beta = np.ones_like(alpha)
        emit_ = b[codes[begin:end]] / scale[:, None]
        for t in range(t1 - 1, t0 - 1, -1):
            s = at[t] - begin
            if t < t1 - 1:
                u, v = at[t + 1] - begin, at[t + 2] - begin
                ahead = emit_[u:v] * beta[u:v]
            beta[s : s + len(ahead)] = ahead @ a.T
            if t == t1 - 1:
                moves += alpha[s : s + len(ahead)].T @ ahead
        later = np.arange(at[t0 + 1] - begin, end - begin)
        size = np.diff(at[t0 : t1 + 1])
        previous = later - np.repeat(size[:-1], size[1:])
        moves += alpha[previous].T @ (emit_[later] * beta[later])
        gamma = alpha * beta
        out += np.stack([np.bincount(codes[begin:end], gamma[:, s], len(b)) for s in range(k)], 1)
        if not t0:
            first = gamma[:n].sum(0)
        ahead = emit_[: at[t0 + 1] - begin] * beta[: at[t0 + 1] - begin]
    return first, a * moves, out, like.sum()


def train_batches(shared):
    """symbol, s0, s1, ...: expected emissions; below -1 transitions from each state, at -1 first states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, a, b = shared.value
        first, moves, out = np.zeros_like(pi), np.zeros_like(a), np.zeros_like(b)
        for batch in batches:
            raw, off = tk.buffers(batch.column("codes"))
            codes, off = raw[off[0] : off[-1]].view(np.uint16), (off - off[0]) // 2
            n = np.diff(off)
            for part in stretches(n):
                x, at = laid(codes, off[:-1][part], n[part])
                f, m, o, _ = expected(x, at, pi, a, b)
                first, moves, out = first + f, moves + m, out + o
        rows = np.concatenate((moves[::-1], first[None], out))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1 - len(a), len(b)).astype(np.int32)), *[pa.array(rows[:, s]) for s in range(len(pi))]], ["symbol", *[f"s{s}" for s in range(len(pi))]])

    return run


def likelihood_batches(shared, norms):
    """norms: for each ending class log10 of what its counts are divided by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, a, b = shared.value
        for batch in batches:
            raw, off = tk.buffers(batch.column("codes"))
            codes, off = raw[off[0] : off[-1]].view(np.uint16), (off - off[0]) // 2
            n, like, ends = np.diff(off), np.zeros(len(off) - 1), np.zeros(len(off) - 1)
            for part in stretches(n):
                x, at = laid(codes, off[:-1][part], n[part])
                like[part] = forward(x, at, pi, a, b)
            endings = np.flatnonzero(codes > WORDS)
            share = np.concatenate(([0.0], np.cumsum(norms.value[codes[endings] - 1 - WORDS])))
            cut = np.searchsorted(endings, off)
            ends = share[cut[1:]] - share[cut[:-1]]
            cols = [batch.column(c) for c in ("doc_id", "_k1", "_k2", "held_out", "n", "n_frequent", "s_frequent", "s_words")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(like / np.log(10) - ends)], ["doc_id", "_k1", "_k2", "held_out", "n", "n_frequent", "s_frequent", "s_words", "like"])

    return run


def start(unigram: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters to begin with: the counts of symbols, disturbed differently in each state."""
    rng = np.random.default_rng(11)
    b = (unigram[:, None] + SMOOTH) * rng.uniform(0.5, 1.5, (len(unigram), states))
    a = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return np.full(states, 1 / states), a, b / b.sum(0)


def lm_scores(spark: SparkSession, docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    scratch, sc = Scratch(spark), spark.sparkContext
    rows = keyed(docs).withColumn("held_out", remainder(F.col("doc_id"), 5) == 1)
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = rows.select("held_out", "text").mapInArrow(count_batches, "h bigint, ending int, c bigint")
    counts = scratch.write(counts.groupBy("h", "ending").agg(F.sum("c").alias("c")))
    ends = rows.filter(~F.col("held_out")).count()
    by_class = {r.ending: (r.c, r.v) for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}  # ENDINGS rows
    total = sum(c for c, _ in by_class.values()) + ends
    types = sum(v for _, v in by_class.values()) + (ends > 0)
    # the most frequent tokens, by a histogram of their counts
    step = F.floor(F.log2("c") * 8).cast("int")
    least, seen = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.b):
        seen += r.n
        if seen > FREQUENT:
            break
        least = r.b
    top = counts.filter(step >= least).toArrow().to_pandas()  # FREQUENT rows at most
    top["u"] = top.h.to_numpy().astype(np.uint64)
    top = top.sort_values(["c", "u"], ascending=[False, True])
    top["code"] = 0
    top.iloc[:WORDS, top.columns.get_loc("code")] = np.arange(1, min(WORDS, len(top)) + 1)
    unigram = np.zeros(1 + WORDS + ENDINGS)
    unigram[0] = ends
    own = top[top.code > 0]
    unigram[own.code.to_numpy()] = own.c.to_numpy()
    rest = {g: [c, v] for g, (c, v) in by_class.items()}
    for g, x in own.groupby("ending"):
        rest[g][0] -= int(x.c.sum())
        rest[g][1] -= len(x)
    norm = np.zeros(ENDINGS)
    for g in range(ENDINGS):
        c, v = rest.get(g, (0, 0))
        unigram[1 + WORDS + g] = c
        norm[g] = np.log10(c + 0.5 * (v + 1))
    top = top.sort_values("u")
    shared = sc.broadcast((top.u.to_numpy(), np.log10(top.c.to_numpy() + 0.5), top.code.to_numpy()))
    fields = f"doc_id {kind}, _k1 bigint, _k2 int, held_out boolean"
    encoded = scratch.write(rows.mapInArrow(encode_batches(shared), f"{fields}, codes binary, n bigint, n_frequent bigint, s_frequent double, s_words double, rare array<bigint>, tf array<bigint>"))
    pi, a, b = start(unigram, states)
    columns = [f"s{s}" for s in range(states)]
    for _ in range(rounds if ends else 0):
        now = sc.broadcast((pi, a, b))
        got = encoded.filter(~F.col("held_out")).select("codes").mapInArrow(train_batches(now), f"symbol int, {', '.join(f'{c} double' for c in columns)}")
        got = got.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).toArrow().to_pandas().sort_values("symbol")  # a row a symbol
        x = got[columns].to_numpy()
        moves, first, out = x[:states][::-1] + SMOOTH, x[states] + SMOOTH, x[states + 1 :] + SMOOTH * (unigram[:, None] + 1) / (unigram.sum() / len(unigram) + 1)
        pi, a, b = first / first.sum(), moves / moves.sum(1, keepdims=True), out / out.sum(0)
    now, norms = sc.broadcast((pi, a, b)), sc.broadcast(norm)
    base = encoded.drop("rare", "tf").mapInArrow(likelihood_batches(now, norms), f"{fields}, n bigint, n_frequent bigint, s_frequent double, s_words double, like double")
    # rare tokens meet their counts
    rare = encoded.select(*K, F.explode(F.arrays_zip("rare", "tf")).alias("r")).select(*K, F.col("r.rare").alias("h"), F.col("r.tf").alias("tf"))
    rare = rare.distinct()  # rows that repeat have the same tokens
    found = rare.join(counts.filter(step < least).select("h", "c"), "h", "left")
    found = found.groupBy(*K).agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("s_rare"), F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("n_rare"))
    out = base.join(scratch.write(found), K, "left")
    s_rare = F.coalesce("s_rare", F.lit(0.0))
    n = F.col("n") + 1
    return out.select(
        "doc_id", "held_out", n.alias("n_tokens"), (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("s_frequent") + s_rare + float(np.log10(ends + 0.5)) - n * float(np.log10(total + 0.5 * (types + 1)))).alias("base_score"),
        (F.col("like") + F.col("s_frequent") - F.col("s_words") + s_rare).alias("score"),
    )

"""Toxicity by the nearest labelled examples.

A bounded sample of labelled rows (EXAMPLES of each label, the first by a hash of their ids) is the index. Terms are words
and their first six and seven bytes, and each of these once more if it occurs twice; all terms of the examples make up the
space. Document frequencies come from all documents. Weights are TF-IDF times the root of 1 + G-squared of the term's
difference between the labels of the sample: no term is left out, telling ones weigh more. Examples are vectors of length one over all their terms. A
document's terms that no example has would only stretch its own vector, by which neither the order of its neighbours nor
the shares of their votes change, so that they need no weights. The nearest are found exactly by an inverted index
with the greatest weight of each term in each block of examples: blocks whose bound stays below the cosines found are not
worked out. Neighbours vote with their cosine as weight, each label weighing as much as
it has among the labels that are learned from. A monotone fit of left-out votes of the examples to their labels turns votes into scores. Documents
without any of the terms get the share of toxic examples among their like.

A null text is empty; an empty text gets a score too. Labels that repeat count once (toxic if any says so); rows without a
label are not learned from, nor are those held out. Rows that repeat get equal results. Without labels all scores are 0.
An empty table gives an empty result; other columns are ignored. The index is broadcast; its size is bounded by EXAMPLES
and the length of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import tokens as tk
from gneiss.llm.common import K, Scratch, keyed, remainder

EXAMPLES = 2048
PREFIXES = (6, 7)
NEAREST = 25
#: Terms of more than one in so many examples go into the matrix.
DENSE = 16
#: Examples of a block, and what rounding may add to a bound.
BLOCK = 32
SLACK = 1e-5
#: Documents that are worked on at once.
STRETCH = 64
THRESHOLD = 0.7


def text_terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its different terms and how often each occurs."""
    for i, j, b, off in tk.chunks(column):
        low = tk.LOWERED[b]
        starts, stops, first = tk.word_stretches(low, off, tk.WORD_BYTE)
        c = tk.prefix_hash(low)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        terms, docs = [tk.stretch_hash(c, starts, stops)], [doc]
        for p in PREFIXES:
            long = stops - starts >= p
            terms.append(tk.mix(tk.stretch_hash(c, starts[long], starts[long] + p) + np.uint64(p)))
            docs.append(doc[long])
        yield i, j, np.concatenate(terms), np.concatenate(docs)


def more_than_once(terms: np.ndarray) -> np.ndarray:
    """The terms that say that these terms occur twice at least."""
    return tk.mix(terms ^ np.uint64(0x5851F42D4C957F2D))


def example_batches(names: list):
    """names: the examples' ids; e is the place in them. twice marks the terms that say that another occurs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = pc.index_in(batch.column("x"), value_set=pa.array(names, pa.string()))
            for i, _, terms, docs in text_terms(batch.column("text")):
                order = np.lexsort((terms, docs))
                terms, docs = terms[order], docs[order]
                new = np.ones(len(terms), bool)
                new[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(terms)))
                base, many = terms[at], tf > 1
                rows = np.concatenate((docs[at], docs[at][many])) + i
                terms = np.concatenate((base, more_than_once(base[many])))
                tf = np.concatenate((tf, np.ones(many.sum(), tf.dtype)))
                yield pa.RecordBatch.from_arrays([e.take(pa.array(rows)), pa.array(terms.astype(np.int64)), pa.array(np.arange(len(terms)) >= len(base)), pa.array(tf.astype(np.int32))], ["e", "term", "twice", "tf"])

    return run


class Space:
    """vocabulary: sorted hashes; bases: sorted hashes of the terms that they are made from."""

    def __init__(self, vocabulary: np.ndarray, bases: np.ndarray):
        self.vocabulary, self.bases = vocabulary, bases
        self.once, self.twice = self.place(bases), self.place(more_than_once(bases))

    def place(self, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == terms, at, -1) if len(self.vocabulary) else np.full(len(terms), -1)

    def vectors(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """How many texts, and for these the places of their terms in the vocabulary and how often each occurs, by text."""
        wide = max(len(self.vocabulary), len(self.bases)) + 1
        for i, j, terms, docs in text_terms(column):
            at = np.minimum(np.searchsorted(self.bases, terms), max(len(self.bases) - 1, 0))
            hit = self.bases[at] == terms if len(self.bases) else np.zeros(len(terms), bool)
            code, tf = np.unique(docs[hit] * wide + at[hit], return_counts=True)
            doc, at = code // wide, code % wide
            one, two = self.once[at] >= 0, (self.twice[at] >= 0) & (tf > 1)
            code = np.concatenate((doc[one] * wide + self.once[at[one]], doc[two] * wide + self.twice[at[two]]))
            tf = np.concatenate((tf[one], np.ones(two.sum(), tf.dtype)))
            order = np.argsort(code)
            yield j - i, code[order] // wide, code[order] % wide, tf[order]


def frequency_batches(space):
    """How many documents of a partition have each term: a row for each term that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(space.value.vocabulary), np.int64)
        for batch in batches:
            for _, _, terms, _ in space.value.vectors(batch.column("text")):
                n += np.bincount(terms, minlength=len(n))
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(n[t])], ["t", "n"])

    return run


class Index:
    """Labelled vectors. terms and tf: one array each for every example. A worker lays out the block-max inverted index when
    it first needs it."""

    def __init__(self, terms: list, tf: list, toxic: np.ndarray, idf: np.ndarray, share: tuple[float, float], fit: bool = True):
        self.idf, self.toxic = idf, toxic.astype(float)
        n = np.bincount(toxic.astype(int), minlength=2)
        self.mass = np.where(toxic > 0, share[1] / max(n[1], 1), share[0] / max(n[0], 1))
        self.own = [self.vector(t, f) for t, f in zip(terms, tf, strict=True)]
        self.laid, self.skipped = False, 0
        none = np.array([not len(t) for t, _ in self.own], bool)
        self.none = float((self.mass * self.toxic)[none].sum() / self.mass[none].sum()) if none.any() else share[1] / max(sum(share), 1)
        self.steps = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        if len(terms) and fit:
            self.steps = self.fit(self.votes(np.arange(len(terms))))

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.idf[terms]
        return terms.astype(np.int32), (w / max(np.sqrt((w * w).sum()), 1e-300)).astype(np.float32)

    def lay(self) -> None:
        """The inverted index. Examples lie in blocks of BLOCK, those of one label and one heaviest term side by side. Terms
        of many examples have a row in each block's matrix and their greatest weight in it, the others postings (place,
        weight)."""
        n = len(self.own)
        heaviest = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in self.own])
        self.order = np.lexsort((np.arange(n), heaviest, self.toxic))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        t, w = (np.concatenate([x[k] for x in self.own]) for k in (0, 1))
        e = np.repeat(place, [len(x[0]) for x in self.own])
        size = np.bincount(t, minlength=len(self.idf))
        dense = size * DENSE > n
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.matrix = np.zeros((self.blocks, int(dense.sum()), BLOCK), np.float32)
        d = dense[t]
        self.matrix[e[d] // BLOCK, self.row[t[d]], e[d] % BLOCK] = w[d]
        self.top = np.ascontiguousarray(self.matrix.max(2, initial=0).T)
        by = np.lexsort((e[~d], t[~d]))
        t, self.examples, self.weights = t[~d][by], e[~d][by], w[~d][by]
        self.at = np.searchsorted(t, np.arange(len(self.idf) + 1))
        self.laid = True

    @staticmethod
    def listed(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of terms one after the other, and which of the terms each belongs to."""
        size = at[terms + 1] - at[terms]
        return np.arange(size.sum()) + np.repeat(at[terms] - np.cumsum(size) + size, size), np.repeat(np.arange(len(terms)), size)

    def cosines(self, n: int, doc: np.ndarray, terms: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
        """Of n vectors, whose weights come by vector, with all examples that may be among the k nearest; 0 for others.

        The postings are added up first. What they give, with the weights of a vector times the greatest of each block,
        bounds the cosines of the block. The blocks with the highest bounds are worked out first; then all whose bound
        reaches the k-th best cosine found so far.
        """
        if not self.laid:
            self.lay()
        dense = self.row[terms] >= 0
        x = np.zeros((n, len(self.top)), np.float32)
        x[doc[dense], self.row[terms[dense]]] = w[dense]
        doc, terms, w = doc[~dense], terms[~dense], w[~dense]
        wide = self.blocks * BLOCK
        post, which = self.listed(self.at, terms)
        got = np.bincount(doc[which] * wide + self.examples[post], w[which] * self.weights[post], n * wide).reshape(n, wide).astype(np.float32)
        bound = (x @ self.top + got.reshape(n, self.blocks, BLOCK).max(2)) * (1 + SLACK) + SLACK

        def work(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(0)):
                rows = np.flatnonzero(need[:, b])
                got[rows, b * BLOCK : (b + 1) * BLOCK] += x[rows] @ self.matrix[b]

        m = min(self.blocks, -(-k // BLOCK) + 1)
        need = np.zeros((n, self.blocks), bool)
        np.put_along_axis(need, np.argpartition(-bound, m - 1, 1)[:, :m], True, 1)
        work(need)
        if m < self.blocks:
            # what isn't worked out yet is too small where it counts
            least = np.partition(got, -k, 1)[:, -k] if wide > k else np.zeros(n)
            more = (bound >= least[:, None]) & ~need
            work(more)
            need |= more
            got[~np.repeat(need, BLOCK, 1)] = 0
            self.skipped += int((~need).sum())
        out = np.zeros((n, len(self.own)), np.float32)
        out[:, self.order] = got[:, : len(self.own)]
        return out

    @staticmethod
    def best(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k largest cosines, to six places, and whose they are; ties go to the first."""
        least = np.partition(cos, -k)[-k] if len(cos) > k else 0.0
        ids = np.flatnonzero((cos >= least - 2e-6) & (cos > 0))
        cos = np.round(cos[ids].astype(float), 6)
        keep = np.lexsort((ids, -cos))[:k]
        keep = keep[cos[keep] > 0]
        return ids[keep], cos[keep]

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples that share a term, and their cosines."""
        return self.best(self.cosines(1, np.zeros(len(terms), int), terms, w, k)[0], k)

    def vote(self, ids: np.ndarray, cos: np.ndarray) -> float:
        w = cos * self.mass[ids]
        return float((w * self.toxic[ids]).sum() / w.sum())

    def many(self, n: int, doc: np.ndarray, terms: np.ndarray, w: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() for each of n vectors."""
        for i in range(0, n, STRETCH):
            j = min(i + STRETCH, n)
            s, e = np.searchsorted(doc, [i, j])
            for cos in self.cosines(j - i, doc[s:e] - i, terms[s:e], w[s:e], k):
                yield self.best(cos, k)

    def votes(self, examples: np.ndarray) -> list[tuple[int, float]]:
        """Of these examples, each left out itself."""
        out = []
        doc = np.repeat(np.arange(len(examples)), [len(self.own[e][0]) for e in examples])
        terms, w = (np.concatenate([self.own[e][k] for e in examples]) for k in (0, 1))
        for e, (ids, cos) in zip(examples.tolist(), self.many(len(examples), doc, terms, w, NEAREST + 1), strict=True):
            if len(ids[ids != e]):
                out.append((e, self.vote(ids[ids != e][:NEAREST], cos[ids != e][:NEAREST])))
        return out

    def fit(self, votes: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Pools neighbouring votes until the shares of toxic examples rise with the votes."""
        pools: list[list[float]] = []
        for x, y, m in sorted((v, self.toxic[e], self.mass[e]) for e, v in votes):
            pools.append([x * m, y * m, m])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if not pools:
            return self.steps
        p = np.array(pools)
        return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]

    def score(self, n: int, doc: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Score and nearest examples of each of n documents."""
        w = (1 + np.log(tf)) * self.idf[terms]
        w = (w / np.sqrt(np.bincount(doc, w * w, n))[doc]).astype(np.float32)
        for ids, cos in self.many(n, doc, terms, w, NEAREST):
            yield (float(np.clip(np.interp(self.vote(ids, cos), *self.steps), 0, 1)) if len(ids) else self.none), ids


def vote_batches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = index.value.votes(batch.column("id").to_numpy()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in got], pa.int64()), pa.array([v for _, v in got], pa.float64())], ["e", "vote"])

    return run


def scored(index: Index, space: Space, steps: tuple, text: pa.Array) -> list:
    index.steps = steps
    if not len(index.own):
        return [(index.none, np.zeros(0, int))] * len(text)
    return [x for part in space.vectors(text) for x in index.score(*part)]


def keep_batches(index, space, steps):
    """Rows, with all columns, whose text scores below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_string()).fill_null("")
            yield batch.filter(pa.array([s < THRESHOLD for s, _ in scored(index.value, space.value, steps, text)], pa.bool_()))

    return run


def score_batches(index, space, steps, names: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scored(index.value, space.value, steps, batch.column("text"))
            evidence = [",".join(names[e] for e in ids[:5]) for _, ids in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array(evidence, pa.string())], ["doc_id", "score", "evidence"])

    return run


def weight(at: np.ndarray, label: np.ndarray, size: int, toxic: np.ndarray) -> np.ndarray:
    """For each of so many terms the root of 1 + G-squared. at, label: each example's terms and its label."""
    n, a = np.bincount(at, minlength=size).astype(float), np.bincount(at, label, size)
    n1, total = toxic.sum(), max(len(toxic), 1)
    part = lambda o, e: o * np.log(np.where(o > 0, o, 1) / np.where(o > 0, e, 1))
    g = part(a, n * n1 / total) + part(n - a, n * (total - n1) / total) + part(n1 - a, (total - n) * n1 / total) + part(total - n1 - n + a, (total - n) * (total - n1) / total)
    return np.sqrt(1 + 2 * np.maximum(g, 0))


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple:
    """The index and its space (both broadcast), the steps of its fit, and its examples' ids."""
    rows, sc = keyed(docs), spark.sparkContext
    labels = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    learn = labels.filter(remainder(F.col("doc_id"), 3) != 1)
    share = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64(F.lit(7), "doc_id")
    sample = learn.filter("toxic = 1").orderBy(place, "doc_id").limit(EXAMPLES).unionByName(learn.filter("toxic = 0").orderBy(place, "doc_id").limit(EXAMPLES))
    sample = scratch.write(sample)  # 2 * EXAMPLES rows at most
    texts = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(*K, "text")).alias("t"))
    texts = scratch.write(texts.select(F.col("doc_id").cast("string").alias("x"), "toxic", F.col("t.text").alias("text")))
    toxic_of = {r.x: r.toxic for r in texts.select("x", "toxic").collect()}  # 2 * EXAMPLES rows at most
    names = sorted(toxic_of)
    terms = texts.repartition(16).mapInArrow(example_batches(names), "e int, term bigint, twice boolean, tf int").toArrow()  # the examples' terms
    e, tf = terms.column("e").to_numpy(), terms.column("tf").to_numpy().astype(np.float32)
    bases = np.unique(terms.filter(pc.invert(terms.column("twice"))).column("term").to_numpy().view(np.uint64))
    term = terms.column("term").to_numpy().view(np.uint64)
    vocabulary = np.unique(term)
    at = np.searchsorted(vocabulary, term).astype(np.int32)
    del terms, term
    space = sc.broadcast(Space(vocabulary, bases))
    df = np.zeros(max(len(vocabulary), 1))
    held = rows.select("text").mapInArrow(frequency_batches(space), "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    df[held.column("t").to_numpy()] = held.column("n").to_numpy()
    del held
    idf = np.log((1 + docs.count()) / (1 + df)) + 1e-3
    toxic = np.array([toxic_of[x] for x in names], int)
    idf *= weight(at, toxic[e], len(df), toxic)
    order = np.argsort(e * np.int64(len(df)) + at)
    e, at, tf = e[order], at[order], tf[order]
    cut = np.searchsorted(e, np.arange(1, len(names)))
    own_terms, own_tf = (np.split(at, cut), np.split(tf, cut)) if names else ([], [])
    index = Index(own_terms, own_tf, toxic, idf, (share.get(0, 0), share.get(1, 0)) if share else (1.0, 0.0), False)
    del own_terms, own_tf, e, at, tf, order
    if not names or not share.get(1):
        index.none = 0.0
    shared = sc.broadcast(index)
    votes = spark.range(len(names)).repartition(24).mapInArrow(vote_batches(shared), "e bigint, vote double").collect()  # a row an example
    return shared, space, index.fit([(r.e, r.vote) for r in votes]), names


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) for each row of docs."""
    index, space, steps, names = learned(spark, docs, labels, Scratch(spark))
    rows = keyed(docs).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(score_batches(index, space, steps, names), f"doc_id {kind}, score double, evidence string")
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that score below the threshold. A second pass over the texts, no shuffle."""
    index, space, steps, _ = learned(spark, docs, labels, Scratch(spark))
    return docs.mapInArrow(keep_batches(index, space, steps), docs.schema)

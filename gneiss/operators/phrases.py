"""Repeated phrases: by n-gram counts over a corpus, and by grammar induction inside each document."""

from __future__ import annotations

import heapq
import re
from collections import Counter as Pairs
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.sources.scratch import Scratch

LEAST = 3
LEAST_TOKENS = 5
LONGEST_WORDS = 40
MOST_PHRASES = 96
MOST_MERGES = 4000


#: Hashes of recurring n-grams that are broadcast at once, and how often the texts are read at most to meet them so.
BROADCAST = 2_000_000
PASSES = 8


def phrase_ngrams(docs: DataFrame, sizes: tuple[int, ...] = (5, 8), key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(n, phrase, occurrences, documents, saving): word n-grams that would pay for a dictionary entry, one token a word.

    The shortest n-grams are counted as 64-bit hashes first. A longer one can't recur more often than those inside it, so
    only places whose shortest n-grams (the first and the last of a longer one) have hashes that recur are made into
    strings, and these are counted exactly. The recurring hashes are broadcast in slices of BROADCAST; if that takes more
    than PASSES slices, the hashes meet the places in a join that shuffles both.
    """
    short = min(sizes)
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    d = docs.select(key, w.alias("w")).filter(F.size("w") >= short)
    # arrays are bound to a variable each, so that they are made once a document and not once a place
    hashes = f"transform(array(transform(w, y -> xxhash64(y))), x -> transform(sequence(0, size(x) - {short}), i -> xxhash64({', '.join(f'x[i + {k}]' for k in range(short))})))[0]"
    scratch = Scratch(docs.sparkSession)
    often = scratch.write(d.select(F.explode(F.expr(hashes)).alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("h"))
    slices = -(-often.count() // BROADCAST)
    # words by their places: slice() would copy the whole array each time
    words = {n: "concat_ws(' ', " + ", ".join(f"v.w[i + {k}]" for k in range(n)) + ")" for n in sizes}
    grams = ", ".join(f"named_struct('n', {n}, 'z', if(size(v.w) >= i + {n}, h[i + {n - short}], null), 'p', if(size(v.w) >= i + {n}, {words[n]}, null))" for n in sizes)
    bound = f"transform(transform(array(named_struct('w', w)), v -> named_struct('w', v.w, 'h', {hashes.replace('(w, y', '(v.w, y')})), v -> transform(array(v.h), h -> transform(h, (a, i) -> named_struct('a', a, 'g', array({grams}))))[0])[0]"
    places = d.select(key, F.explode(F.expr(bound)).alias("x")).select(key, "x.a", F.explode("x.g").alias("g"))
    places = places.filter("g.p is not null").select(key, "a", "g.n", "g.z", F.col("g.p").alias("phrase"))
    if slices > PASSES:
        found = places.join(often.withColumnRenamed("h", "a"), "a").join(often.withColumnRenamed("h", "z"), "z")
    else:
        found = places.filter("false")
        for k in range(slices):
            part = F.broadcast(often.filter(F.pmod("h", F.lit(slices)) == k).withColumnRenamed("h", "a"))
            found = found.unionByName(places.filter(F.pmod("a", F.lit(slices)) == k).join(part, "a").select(places.columns))
    g = found.groupBy("n", "phrase", key).agg(F.count("*").alias("k")).groupBy("n", "phrase").agg(F.sum("k").alias("occurrences"), F.count(key).alias("documents")).filter(F.col("occurrences") >= least)
    return g.withColumn("saving", saved(F.col("occurrences"), F.col("n")).cast("long")).filter("saving > 0")


def induced(texts: list[str], count=None) -> list[str]:
    """Phrases built by merging the most valuable adjacent pair of symbols, again and again.

    Occurrences are kept by pair and updated around each merge, so that the work follows the merges, not their number
    times the length. A pair's value is its non-overlapping occurrences times the tokens of the phrase; of equal values the
    one that comes first in the text wins.
    """
    count = count or (lambda s: len(s.split()))
    symbols: list[str] = []
    at: list[int] = []  # symbol at each place; -1: a border between texts
    ids: dict[str, int] = {}
    for t in texts:
        for w in re.findall(r"\S+", t):
            if w not in ids:
                ids[w] = len(symbols)
                symbols.append(w)
            at.append(ids[w])
        at.append(-1)
    n = len(at)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # a pair that is rarer now stays rarer, so that only the others need their places
    often = {p for p, k in Pairs(zip(at, at[1:], strict=False)).items() if k >= LEAST and p[0] >= 0 and p[1] >= 0}
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, p in enumerate(zip(at, at[1:], strict=False)):
        if p in often:
            where[p].add(i)

    def value(pair) -> tuple[int, int]:
        if pair[0] == pair[1]:  # runs overlap with themselves
            k, skip = 0, -1
            for i in sorted(where[pair]):
                if i != skip:
                    k, skip = k + 1, after[i]
        else:
            k = len(where[pair])
        phrase = f"{symbols[pair[0]]} {symbols[pair[1]]}"
        if k < LEAST or phrase.count(" ") >= LONGEST_WORDS:
            return 0, 0
        return k * count(phrase), min(where[pair])

    heap = []
    for pair in list(where):
        v, i = value(pair)
        if v:
            heapq.heappush(heap, (-v, i, pair))
    built: list[str] = []
    while heap and len(built) < MOST_MERGES:
        v, i, pair = heapq.heappop(heap)
        now = value(pair)
        if now != (-v, i):
            if now[0]:
                heapq.heappush(heap, (-now[0], now[1], pair))
            continue
        new = len(symbols)
        symbols.append(f"{symbols[pair[0]]} {symbols[pair[1]]}")
        built.append(symbols[new])
        touched = set()
        for i in sorted(where.pop(pair)):
            j = after[i]
            if at[i] != pair[0] or j >= n or at[j] != pair[1]:
                continue
            p, q = before[i], after[j]
            if p >= 0 and at[p] >= 0:
                if (at[p], at[i]) in where:
                    where[at[p], at[i]].discard(p)
                    touched.add((at[p], at[i]))
                where[at[p], new].add(p)
                touched.add((at[p], new))
            if q < n and at[q] >= 0:
                if (at[j], at[q]) in where:
                    where[at[j], at[q]].discard(j)
                    touched.add((at[j], at[q]))
                where[new, at[q]].add(i)
                touched.add((new, at[q]))
            at[i], at[j], after[i] = new, -2, q
            if q < n:
                before[q] = i
        for t in touched:
            if where.get(t):
                v, i = value(t)
                if v:
                    heapq.heappush(heap, (-v, i, t))
    return sorted(built, key=lambda s: (-len(s), s))


def saved(n, tokens):
    """What an entry saves: n occurrences become references of two tokens, the entry costs its tokens and two more. For
    numbers and columns alike."""
    return n * tokens - n * 2 - tokens - 2


def places(text: str, phrase: str) -> list[int]:
    """Where a phrase occurs with white space or an end on either side, without overlaps."""
    out, i, n = [], text.find(phrase), len(phrase)
    while i >= 0:
        j = i + n
        if (not i or text[i - 1].isspace()) and (j == len(text) or text[j].isspace()):
            out.append(i)
            i = text.find(phrase, j)
        else:
            i = text.find(phrase, i + 1)
    return out


def select(texts: list[str], candidates: list[str], count=None, taken: frozenset[int] = frozenset()) -> tuple[list[tuple[int, str, int, int]], list[str]]:
    """The phrases that pay for their entry, greedily, and the texts with references: (number, phrase, occurrences, saving).
    Phrases hold single blanks only, so that none reaches over the border between two texts."""
    count = count or (lambda s: len(s.split()))
    border = "\n\0\n"
    whole = border.join(texts)
    if whole.count(border) >= max(len(texts), 1):
        raise ValueError("a text holds the border of texts")
    known = {c: (len(at), count(c)) for c in set(candidates) if whole.count(c) >= LEAST and len(at := places(whole, c)) >= LEAST}
    order = sorted((c for c, (_, t) in known.items() if t >= LEAST_TOKENS), key=lambda p: (-known[p][0] * known[p][1], -len(p), p))
    out, number = [], 0
    for p in order:
        if len(out) >= MOST_PHRASES:
            break
        at, t = places(whole, p), known[p][1]
        k = len(at)
        saving = saved(k, t)
        if k < LEAST or saving <= 0:
            continue
        number += 1
        while number in taken:
            number += 1
        cut = [0, *(x for i in at for x in (i, i + len(p))), len(whole)]
        whole = f"§{number}".join(whole[i:j] for i, j in zip(cut[::2], cut[1::2], strict=True))
        out.append((number, p, k, saving))
    return out, whole.split(border) if texts else []


def references(texts: list[str]) -> frozenset[int]:
    """The numbers that stand behind a section sign already."""
    return frozenset(int(x) for t in texts if "§" in t for x in re.findall(r"§(\d+)", t))


def build_dictionary(texts: list[str], count=None) -> tuple[list[tuple[int, str, int, int]], list[str]]:
    return select(texts, induced(texts, count), count, references(texts))


def expand_references(text: str, phrases: dict[int, str]) -> str:
    """The inverse; references without an entry stay."""
    return re.sub(r"§(\d+)", lambda m: phrases.get(int(m[1]), m[0]), text)


def document_phrases(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, number, phrase, occurrences, saving) for each document by itself; documents are independent, so this is a map."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = [(k, *p) for k, t in zip(f[key], f["text"], strict=True) for p in build_dictionary((t or "").split("\n"))[0]]
            yield pd.DataFrame(rows, columns=[key, "number", "phrase", "occurrences", "saving"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, number int, phrase string, occurrences long, saving long")

"""Token counters. Every operator that weighs costs takes one; "words" and "chars" stay in the JVM, a vocabulary file in
tiktoken's format is counted in an Arrow UDF whose encoder is built once per worker."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Counter = Callable[[Column], Column]
#: Fixed value: how byte-pair vocabularies of this kind split text first.
SPLIT = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


def words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def chars(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.coalesce(F.ceil(F.length(c) / 4), F.lit(0)).cast("int")


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def vocabulary(path: str) -> Counter:
    """Counts by the vocabulary file at a path that executors can read."""

    @F.pandas_udf(T.IntegerType())
    def count(s: pd.Series) -> pd.Series:
        e = encoder(path)
        return s.map(lambda x: len(e.encode_ordinary(x)) if x else 0)

    return lambda c: count(F.coalesce(c, F.lit("")))


def cheapest(count: Counter, *candidates: Column) -> Column:
    """The candidate with the fewest tokens, the first of equals."""
    best = F.array_min(F.array(*[F.struct(count(c).alias("n"), F.lit(i).alias("i"), c.alias("c")) for i, c in enumerate(candidates)]))
    return best["c"]

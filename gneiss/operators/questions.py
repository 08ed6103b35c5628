"""Questions with known answers made from documents, and scores of answers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators import phrases as ph
from gneiss.plans import codec
from gneiss.sources.blocks import Document


def questions(doc: Document, seed: str = "") -> list[tuple[str, str, str]]:
    """(type, question, answer): a few paragraphs' next words, a cell of each table, each codebook's first code, a few phrases."""
    place = lambda s: hashlib.md5((seed + s).encode()).hexdigest()
    out = []
    for b in sorted((b for b in doc.blocks if b.kind == "para" and len(b.text.split()) > 5), key=lambda b: place(b.text))[:3]:
        w = b.text.split()
        out.append(("prose", f"Which word follows \"{' '.join(w[:5])}\"?", w[5]))
    for b in doc.blocks:
        if b.kind == "table" and b.rows and len(b.cols) > 1:
            r = min(b.rows, key=lambda r: place("\t".join(r)))
            out.append(("lookup", f"What is the {b.cols[-1]} of the row whose {b.cols[0]} is {r[0]}?", r[-1]))
            _, books = codec.coded(b, codec.token_chars)
            for i, book in books.items():
                code, value = next(iter(book.items()))
                out.append(("deref_code", f"What does code {code} stand for in column {b.cols[i]}?", value))
    entries, _ = ph.build_dictionary([t for _, _, t in codec.slots(doc)])
    return out + [("deref_dict", f"What does §{n} stand for?", phrase) for n, phrase, _, _ in entries[:3]]


def question_rows(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    return codec.map_documents(blocks, key, "type string, question string, answer string", lambda k, d: questions(d, str(k)))


#: Prompts of more tokens than this are of the bucket.
BUCKETS = {"large": 50_000, "medium": 10_000}


def bucket(tokens: Column, bounds: dict[str, int] = BUCKETS) -> Column:
    """The size bucket of a prompt; small below all bounds."""
    out = F.when(F.lit(False), F.lit(""))
    for name, least in sorted(bounds.items(), key=lambda x: -x[1]):
        out = out.when(tokens > least, F.lit(name))
    return out.otherwise("small")


def score_answers(answers: DataFrame, by: list[str]) -> DataFrame:
    """(by..., correct, n, accuracy, mean_tokens) of answers (gold, pred, prompt_tokens): right if the gold text occurs."""
    right = F.contains(F.lower("pred"), F.lower(F.trim("gold"))).cast("int")
    return answers.groupBy(*by).agg(F.sum(right).alias("correct"), F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg("prompt_tokens").alias("mean_tokens"))

"""Consistent changes to numbers and names, for tests whether answers come from the text."""

from __future__ import annotations

import hashlib
import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.sources.blocks import Document


def trimmed(blocks: DataFrame, most: int = 100) -> DataFrame:
    """Blocks whose tables keep their first rows only."""
    return blocks.withColumn("rows", F.slice("rows", 1, most))


def perturbed(number: Column, doc: Column) -> Column:
    """A whole number times 0.5 to 1.5, the same for a number everywhere in a document and in every run."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", doc.cast("string"), number.cast("string"))), 1, 4), 16, 10).cast("long")
    return F.floor(number * (500 + h % 1001) / F.lit(1000.0)).cast("long")


def factor(doc: str, number: str) -> float:
    return (500 + int(hashlib.md5(f"{doc}:{number}".encode()).hexdigest()[:4], 16) % 1001) / 1000


def perturb_text(text: str, doc: str, names: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """The text with names replaced and numbers changed, and what each number became."""
    for a, b in (names or {}).items():
        text = text.replace(a, b)
    changed: dict[str, str] = {}

    def one(m: re.Match) -> str:
        n = m[0]
        if n not in changed:
            digits = len(n.partition(".")[2])
            changed[n] = f"{float(n) * factor(doc, n):.{digits}f}"
        return changed[n]

    return re.sub(r"\d+(?:\.\d+)?", one, text), changed


def perturb_document(doc: Document, name: str, names: dict[str, str] | None = None) -> tuple[Document, dict[str, str]]:
    """A document with names and numbers changed alike in all its texts, items, pairs and cells."""
    changed: dict[str, str] = {}

    def f(s: str) -> str:
        s, c = perturb_text(s, name, names)
        changed.update(c)
        return s

    blocks = [
        replace(b, text=f(b.text), items=[f(x) for x in b.items], cols=[f(x) for x in b.cols], rows=[[f(x) for x in r] for r in b.rows], pairs=[(f(k), f(v)) for k, v in b.pairs], caption=f(b.caption))
        if b.kind not in ("page", "elision", "figure", "quote") else b
        for b in doc.blocks
    ]
    return Document(f(doc.title), blocks, doc.source), changed

"""Differences of two versions of a document, block by block and, in tables, row by row and cell by cell."""

from __future__ import annotations

import difflib
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.plans import codec
from gneiss.sources.blocks import Block, Document


def digest(b: Block) -> str:
    return hashlib.sha256(repr(codec.canonical(Document("", [b]))[1]).encode()).hexdigest()


def rendered(b: Block) -> list[str]:
    return codec.encode(Document("", [b]), codec.Options(codes=False, dictionary=False, clean=False)).split("\n")[1:-1]


def align(old: list[Block], new: list[Block]) -> list[tuple[str, Block | None, Block | None]]:
    """("=", "~", "-" or "+", old, new): equal blocks are anchors; between anchors blocks of one kind that are alike are
    paired in order, the others are removed or added."""
    a, b = [digest(x) for x in old], [digest(x) for x in new]
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [("=", old[i], new[j]) for i, j in zip(range(i1, i2), range(j1, j2), strict=True)]
            continue
        j = j1
        for i in range(i1, i2):
            match = next((k for k in range(j, j2) if old[i].kind == new[k].kind and alike(old[i], new[k])), None)
            if match is None:
                out.append(("-", old[i], None))
                continue
            out += [("+", None, new[k]) for k in range(j, match)]
            out.append(("~", old[i], new[match]))
            j = match + 1
        out += [("+", None, new[k]) for k in range(j, j2)]
    return out


def alike(a: Block, b: Block) -> bool:
    if a.kind == "table":
        return bool(set(a.cols) & set(b.cols)) or difflib.SequenceMatcher(None, repr(a.rows), repr(b.rows)).ratio() > 0.6
    return difflib.SequenceMatcher(None, "\n".join(rendered(a)), "\n".join(rendered(b))).ratio() > 0.6


def table_diff(a: Block, b: Block) -> tuple[list[str], str]:
    """Changed cells, added and removed rows; by the first column that is a key on both sides, else by position."""
    out = [f"!C\t{chr(9).join(b.cols)}"]
    if a.caption != b.caption:
        out.append(f"~ caption {a.caption}->{b.caption}")
    same = a.cols == b.cols
    key = next((i for i in range(len(b.cols)) if same and len({r[i] for r in a.rows}) == len(a.rows) and len({r[i] for r in b.rows}) == len(b.rows)), None)
    if key is None:
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [tuple(r) for r in a.rows], [tuple(r) for r in b.rows], autojunk=False).get_opcodes():
            if tag != "equal":
                out += ["- " + "\t".join(r) for r in a.rows[i1:i2]] + ["+ " + "\t".join(r) for r in b.rows[j1:j2]]
        return out, "(matched by position)"
    old = {r[key]: r for r in a.rows}
    for r in b.rows:
        o = old.pop(r[key], None)
        if o is None:
            out.append("+ " + "\t".join(r))
        elif o != r:
            out.append("~ " + "\t".join(x if x == y else f"{x}->{y}" for x, y in zip(o, r, strict=True)))
    out += ["- " + "\t".join(r) for r in old.values()]
    return out, f"(matched by key: {b.cols[key]})"


def diff(old: Document, new: Document, names: tuple[str, str] = ("old", "new"), summary: bool = False, granularity: str = "cell") -> str:
    """The differences as text: a line for the number of equal blocks, a region for each change."""
    strip = lambda d: [b for b in codec.prepared(d, codec.Options()).blocks if b.kind != "page"]
    out, heading, equal = [f"!DIFF {names[0]} -> {names[1]}"], "document start", 0
    body: list[str] = []
    for tag, a, b in align(strip(old), strip(new)):
        shown = b or a
        if shown.kind == "heading":
            heading = shown.text
        if tag == "=":
            equal += 1
            continue
        size = f"  table {len(shown.rows)}x{len(shown.cols)}" if shown.kind == "table" else ""
        mark = {"~": "!~", "+": "!+", "-": "!-"}[tag]
        lines: list[str] = []
        note = ""
        if tag == "~" and a.kind == "table" and granularity == "cell":
            lines, note = table_diff(a, b)
        else:
            lines = [f"- {x}" for x in (rendered(a) if a else [])] + [f"+ {x}" for x in (rendered(b) if b else [])]
        body.append(f"{mark} {heading}{size} {note}".rstrip())
        if not summary:
            body += lines
    return "\n".join([out[0], f"!= {equal}", *body]) + "\n"


def reshape(text: str, to: str) -> str:
    """A diff as Markdown or JSON lines."""
    import json

    rows, region = [], ""
    for line in text.splitlines():
        if line[:2] in ("!~", "!+", "!-"):
            region = line[3:]
        rows.append({"region": region, "op": line[:1] if line[:2] in ("- ", "+ ", "~ ") else "meta", "text": line[2:] if line[:2] in ("- ", "+ ", "~ ") else line})
    if to == "json":
        return json.dumps(rows, ensure_ascii=False)
    return "\n".join(f"## {x['text'][3:]}" if x["text"][:2] in ("!~", "!+", "!-") else f"`{x['op']}` {x['text']}" if x["op"] != "meta" else x["text"] for x in rows)


def diff_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, diff) of two versions of a corpus of blocks. Documents with equal fingerprints are settled by the join
    and never reach Python."""
    digests = lambda d: F.sha2(F.to_json("blocks"), 256)
    o, n = codec.documents_of(old, key), codec.documents_of(new, key)
    o = o.select(key, F.col("title").alias("ot"), F.col("blocks").alias("ob"), digests(o).alias("oh"))
    n = n.select(key, F.col("title").alias("nt"), F.col("blocks").alias("nb"), digests(n).alias("nh"))
    j = o.join(n, key, "full")
    status = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "removed").when(F.col("oh") == F.col("nh"), "same").otherwise("changed")
    sent = lambda c: F.when(status == "changed", F.col(c)).alias(c)  # noqa: E731  blocks of the others stay in the JVM
    j = j.select(key, status.alias("status"), sent("ot"), sent("ob"), sent("nt"), sent("nb"))
    kind = j.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            one = lambda s, ot, ob, nt, nb: diff(Document(ot or "", [codec.from_row(x) for x in ob]), Document(nt or "", [codec.from_row(x) for x in nb])) if s == "changed" else ""
            yield pd.DataFrame({key: f[key], "status": f["status"], "diff": [one(*r) for r in zip(f["status"], f["ot"], f["ob"], f["nt"], f["nb"], strict=True)]})

    return j.mapInPandas(run, f"`{key}` {kind}, status string, diff string")

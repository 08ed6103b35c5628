"""python -m gneiss convert|stats|verify|expand|expand-elided|validate|diff FILE..."""

from __future__ import annotations

import argparse
import json
import sys

from gneiss.operators.diff import diff, reshape
from gneiss.operators.sections import number
from gneiss.plans import codec
from gneiss.sources.blocks import Document, read


def outline(doc: Document, count=codec.token_words) -> tuple[list[str], dict[str, list]]:
    """Section numbers of the blocks, and the blocks of each section."""
    ids = iter(number([b.level for b in doc.blocks if b.kind == "heading"]))
    now, sections = "0", {"0": []}
    for b in doc.blocks:
        if b.kind == "heading":
            now = next(ids)
            sections[now] = []
        sections[now].append(b)
    return list(sections), sections


def until(doc: Document, page: int | None) -> Document:
    """The blocks up to the end of a page; all without page marks."""
    last = next((i for i, b in enumerate(doc.blocks) if page is not None and b.kind == "page" and b.number > page), None)
    return Document(doc.title, doc.blocks[:last], doc.source)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gneiss")
    sub = p.add_subparsers(dest="do", required=True)
    for name in ("convert", "stats", "verify", "expand", "expand-elided", "validate", "diff"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("more", nargs="*")
        s.add_argument("-o", "--output")
        s.add_argument("--to", default="dense", choices=[*codec.FORMATS, "skeleton", "md"])
        s.add_argument("--tier", action="store_true")
        s.add_argument("--legend", action=argparse.BooleanOptionalAction, default=False)
        s.add_argument("--max-pages", type=int, help="read blocks up to this page mark")
        s.add_argument("--granularity", default="cell", choices=["cell", "line"])
        s.add_argument("--json", action="store_true")
        s.add_argument("--raw", action="store_true", help="no column codes")
        s.add_argument("--summary", action="store_true")
    a = p.parse_args(args)
    try:
        text, code = run(a)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.output:
        with open(a.output, "w") as f:
            f.write(text)
    else:
        print(text, end="" if text.endswith("\n") else "\n")
    return code


def run(a) -> tuple[str, int]:
    o = codec.Options(codes=not a.raw, tier=a.tier, legend=a.legend)
    if a.do == "validate":
        with open(a.input) as f:
            found = codec.validate(f.read())
        rows = [{"line": n, "rule": rule, "detail": detail} for n, rule, detail in found]
        return json.dumps(rows) if a.json else "\n".join(f"{n}: {rule}: {detail}" for n, rule, detail in found) or "ok", int(bool(found))
    doc = until(read(a.input), a.max_pages)
    if a.do == "diff":
        text = diff(doc, until(read(a.more[0]), a.max_pages), (a.input, a.more[0]), a.summary, a.granularity)
        return (reshape(text, a.to) if a.to in ("md", "json") else text), 0
    if a.do == "stats":
        return json.dumps({k: codec.token_chars(f(doc)) for k, f in codec.FORMATS.items()}), 0
    if a.do == "verify":
        c = codec.compare(doc, codec.decode(codec.encode(doc, o)))
        return json.dumps(c), int(c["distinct_recall"] <= 0.995)
    if a.do == "expand-elided":
        _, store = codec.set_aside(doc, o.count)
        if missing := [x for x in a.more if x not in store]:
            return f"unknown: {', '.join(missing)}; there are: {', '.join(store)}", 1
        return "\n".join(store[x] for x in a.more), 0
    ids, sections = outline(doc)
    if a.do == "expand":
        keep = [b for s in ids if any(s == w or s.startswith(w + ".") for w in a.more) for b in sections[s]]
        return codec.encode(Document(doc.title, keep), o), 0
    if a.to == "skeleton":
        cost = {s: sum(codec.token_words(codec.markdown(Document("", [b]))) for b in bs if b.kind != "heading") for s, bs in sections.items()}
        name = {s: bs[0].text if bs and bs[0].kind == "heading" else "(preamble)" for s, bs in sections.items()}
        return "\n".join(f"{s} {name[s]} ~{cost[s]}" for s in ids if s != "0" or cost[s]) + "\n", 0
    return (codec.encode(doc, o) if a.to == "dense" else codec.FORMATS["markdown" if a.to == "md" else a.to](doc)), 0


if __name__ == "__main__":
    sys.exit(main())

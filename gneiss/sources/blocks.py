"""Documents as blocks, and the readers that need a parser: Markdown, HTML, delimited text and office files. Readers run as
maps over documents; nothing is shuffled."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FIELDS = (
    "kind string, level int, text string, items array<string>, ordered boolean, cols array<string>, rows array<array<string>>, caption string, "
    "grp string, pairs array<struct<k:string,v:string>>, lang string, number int, eid string, tokens int, n_items int"
)


@dataclass
class Block:
    """kind is one of heading, para, list, table, kv, figure, code, quote, page, elision; the fields that it doesn't use
    keep their defaults. Tables are rectangular: missing headers are c1, c2, ..., missing cells empty."""

    kind: str
    text: str = ""
    level: int = 0
    items: list[str] = field(default_factory=list)
    ordered: bool = False
    cols: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    caption: str = ""
    grp: str = ""
    pairs: list[tuple[str, str]] = field(default_factory=list)
    lang: str = ""
    number: int = 0
    eid: str = ""
    tokens: int = 0
    n_items: int = 0

    def __post_init__(self):
        if self.kind == "table":
            width = max([len(self.cols), *map(len, self.rows)])
            self.cols = self.cols + [f"c{i + 1}" for i in range(len(self.cols), width)]
            self.rows = [r + [""] * (width - len(r)) for r in self.rows]


@dataclass
class Document:
    title: str = ""
    blocks: list[Block] = field(default_factory=list)
    source: str = ""


def squeezed(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def read_plain(text: str, name: str = "") -> Document:
    parts = (squeezed(p) for p in re.split(r"\n\s*\n", text))
    return Document(name, [Block("para", p) for p in parts if p])


def table_row(line: str) -> list[str]:
    """The cells of a Markdown table row."""
    line = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [re.sub(r"<br\s*/?>", " ", c.replace("\\|", "|")).strip() for c in re.split(r"(?<!\\)\|", line)]


_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def read_markdown(text: str, name: str = "") -> Document:
    doc, para, listed = Document(), [], None
    lines = text.splitlines()

    def close() -> None:
        nonlocal listed
        if para:
            doc.blocks.append(Block("para", " ".join(para)))
            para.clear()
        if listed:
            doc.blocks.append(listed)
            listed = None

    i = 0
    while i < len(lines):
        line = lines[i].strip()
        i += 1
        if m := re.match(r"^```(\w*)", line):
            close()
            body = []
            while i < len(lines) and not lines[i].strip().startswith("```"):
                body.append(lines[i])
                i += 1
            i += 1
            doc.blocks.append(Block("code", "\n".join(body), lang=m[1]))
        elif "|" in line and i < len(lines) and "-" in lines[i] and "|" in lines[i] and _RULE.match(lines[i]):
            close()
            rows, head = [], table_row(line)
            i += 1
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                rows.append(table_row(lines[i]))
                i += 1
            doc.blocks.append(Block("table", cols=head, rows=rows))
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            close()
            if len(m[1]) == 1 and not doc.blocks and not doc.title:
                doc.title = m[2]
            else:
                doc.blocks.append(Block("heading", m[2], level=len(m[1])))
        elif m := re.match(r"^!\[([^\]]*)\]\([^)]*\)$", line):
            close()
            doc.blocks.append(Block("figure", m[1], lang="image"))
        elif m := re.match(r"^(?:([-*+])|\d+[.)])\s+(.*)$", line):
            ordered = m[1] is None
            if para or listed and listed.ordered != ordered:
                close()
            listed = listed or Block("list", ordered=ordered)
            listed.items.append(m[2])
        elif line.startswith(">"):
            close()
            doc.blocks.append(Block("quote", line[1:].strip()))
        elif not line:
            close()
        else:
            if listed:
                close()
            para.append(line)
    close()
    doc.title = doc.title or name
    return doc


def read_delimited(text: str, name: str = "") -> Document:
    """Comma, tab or otherwise separated text; the first row names the columns."""
    try:
        dialect = csv.Sniffer().sniff(text[:8192])
    except csv.Error:
        dialect = csv.excel
    rows = [list(r) for r in csv.reader(io.StringIO(text), dialect)]
    return Document(name, [Block("table", cols=rows[0], rows=rows[1:], caption=name)] if rows else [])


class _Html(HTMLParser):
    """Collects the blocks of a page. An element inside another that is already being collected adds its text there, so
    that no text comes twice; inside a table only cells count."""

    LEAF = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "title"}
    HIDDEN = {"script", "style", "noscript", "svg"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.doc, self.open, self.parts, self.hidden = Document(), "", [], 0
        self.lists: list[list] = []
        self.tables: list[dict] = []

    def text(self) -> str:
        out = "".join(self.parts).strip("\n") if self.open == "pre" else squeezed(" ".join(p.strip() for p in self.parts if p.strip()))
        self.parts = []
        return out

    def done(self) -> None:
        kind, self.open = self.open, self.open
        text = self.text()
        self.open = ""
        if not kind or not text.strip():
            return
        if kind == "title":
            self.doc.title = text
        elif kind[0] == "h":
            self.doc.blocks.append(Block("heading", text, level=int(kind[1])))
        else:
            self.doc.blocks.append(Block({"p": "para", "pre": "code", "blockquote": "quote"}[kind], text))

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag == "table":
            self.done()
            self.tables.append({"rows": [], "head": False, "caption": "", "cell": None})
        elif self.tables:
            t = self.tables[-1]
            if tag == "tr":
                t["rows"].append([])
            elif tag in ("td", "th"):
                t["rows"] = t["rows"] or [[]]
                t["rows"][-1].append([])
                t["cell"] = t["rows"][-1][-1]
                if tag == "th" and not any(any(squeezed(" ".join(c)) for c in r) for r in t["rows"][:-1]):
                    t["head"] = True
            elif tag == "caption":
                t["cell"] = []
                t["words"] = t["cell"]
        elif tag in ("ul", "ol"):
            if not self.lists:
                self.done()
            self.lists.append([tag == "ol", []])
        elif tag == "li" and self.lists:
            if len(self.lists) == 1:
                self.item()
                self.lists[0][1].append("")
        elif tag == "img":
            alt = (dict(attrs).get("alt") or "").strip()
            if alt and not self.open and not self.lists:
                self.doc.blocks.append(Block("figure", alt, lang="image"))
        elif tag in self.LEAF and not self.lists and self.open != "blockquote":
            self.done()
            self.open = tag

    def item(self) -> None:
        text = squeezed(" ".join(p.strip() for p in self.parts if p.strip()))
        self.parts = []
        if self.lists and self.lists[0][1]:
            self.lists[0][1][-1] = squeezed(self.lists[0][1][-1] + " " + text)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "table" and self.tables:
            t = self.tables.pop()
            rows = [r for r in ([squeezed(" ".join(c)) for c in r] for r in t["rows"]) if any(r)]
            if rows:
                head = rows.pop(0) if t["head"] else []
                self.doc.blocks.append(Block("table", cols=head, rows=rows, caption=squeezed(" ".join(t.get("words", [])))))
        elif self.tables:
            if tag in ("td", "th", "caption"):
                self.tables[-1]["cell"] = None
        elif tag in ("ul", "ol") and self.lists:
            if len(self.lists) == 1:
                self.item()
                ordered, items = self.lists.pop()
                if items := [x for x in items if x]:
                    self.doc.blocks.append(Block("list", items=items, ordered=ordered))
            else:
                self.lists.pop()
        elif tag == self.open:
            self.done()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.tables:
            if self.tables[-1]["cell"] is not None:
                self.tables[-1]["cell"].append(data)
        elif self.open or self.lists and self.lists[0][1]:
            self.parts.append(data)

    def close(self):
        super().close()
        while self.lists:
            self.handle_endtag("ul")
        self.done()


def read_html(text: str, name: str = "") -> Document:
    p = _Html()
    p.feed(text)
    p.close()
    p.doc.title = p.doc.title or name
    return p.doc


def closed_references(html: str) -> str:
    """Ampersands that begin no character reference closed by a semicolon are escaped, so that a reader leaves them as written."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")


def read_html_closed(text: str, name: str = "") -> Document:
    """As read_html, but references without a semicolon, which browsers read too, stay as they are written."""
    return read_html(closed_references(text), name)


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == tag)


def read_docx(data: bytes, name: str = "") -> Document:
    """Paragraphs, lists by style, headings and tables of a word-processor file, in their order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(e) == "body")
    doc, listed = Document(name), None
    for e in body:
        if _local(e) == "p":
            style = next((v for x in e.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            text = squeezed(_texts(e))
            if not text:
                continue
            if "list" in style.lower():
                if listed is None:
                    listed = Block("list", ordered="number" in style.lower())
                    doc.blocks.append(listed)
                listed.items.append(text)
                continue
            listed = None
            if style.lower() == "title" and doc.title == name:
                doc.title = text
            elif m := re.match(r"(?i)heading\s*(\d)", style):
                doc.blocks.append(Block("heading", text, level=int(m[1])))
            else:
                doc.blocks.append(Block("heading", text, level=1) if style.lower() == "title" else Block("para", text))
        elif _local(e) == "tbl":
            listed = None
            rows = [[squeezed(" ".join(_texts(p) for p in c.iter() if _local(p) == "p")) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            rows = [r for r in rows if any(r)]
            if rows:
                doc.blocks.append(Block("table", cols=rows[0], rows=rows[1:]))
    return doc


def read_xlsx(data: bytes, name: str = "") -> Document:
    """Each sheet as a table of its cached values, without empty rows and columns."""
    doc = Document(name)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = set(z.namelist())
        shared = [_texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in files else []
        links = {e.attrib["Id"]: e.attrib["Target"] for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            path = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            grid: dict[int, dict[int, str]] = {}
            for c in (e for e in ElementTree.fromstring(z.read(path)).iter() if _local(e) == "c"):
                letters, digits = re.match(r"([A-Z]+)(\d+)", c.attrib["r"]).groups()
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                v = _texts(c, "v")
                text = shared[int(v)] if c.attrib.get("t") == "s" and v else _texts(c) if c.attrib.get("t") == "inlineStr" else v
                if text.strip():
                    grid.setdefault(int(digits), {})[col] = squeezed(text)
            cols = sorted({c for r in grid.values() for c in r})
            rows = [[grid[r].get(c, "") for c in cols] for r in sorted(grid)]
            if rows:
                head = rows.pop(0) if len(rows) > 1 else []
                doc.blocks.append(Block("table", cols=head, rows=rows, caption=sheet.attrib["name"], grp=sheet.attrib["name"]))
    return doc


def read_pptx(data: bytes, name: str = "") -> Document:
    """Each slide as a heading, its texts as a list or paragraph, its tables, charts and notes."""
    doc = Document(name)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for i, path in enumerate(slides, 1):
            title, bullets, extra = "", [], []
            for shape in ElementTree.fromstring(z.read(path)).iter():
                if _local(shape) == "sp":
                    kind = next((x.attrib.get("type", "") for x in shape.iter() if _local(x) == "ph"), "")
                    texts = [t for p in shape.iter() if _local(p) == "p" if (t := squeezed(_texts(p)))]
                    if "title" in kind.lower():
                        title = " ".join(texts)
                    else:
                        bullets += texts
                elif _local(shape) == "tbl":
                    rows = [[squeezed(_texts(c)) for c in r if _local(c) == "tc"] for r in shape if _local(r) == "tr"]
                    extra.append(Block("table", cols=rows[0], rows=rows[1:]) if rows else None)
                elif _local(shape) == "chart":
                    extra.append(Block("figure", "chart", lang="chart"))
            doc.blocks.append(Block("heading", title or f"Slide {i}", level=2))
            if bullets:
                doc.blocks.append(Block("list", items=bullets) if len(bullets) > 1 else Block("para", bullets[0]))
            doc.blocks += [b for b in extra if b]
            links = f"ppt/slides/_rels/{posixpath.basename(path)}.rels"
            linked = [e.attrib["Target"] for e in ElementTree.fromstring(z.read(links)) if e.attrib.get("Type", "").endswith("/notesSlide")] if links in z.namelist() else []
            notes = posixpath.normpath(posixpath.join("ppt/slides", linked[0])) if linked else ""
            if notes in z.namelist() and (t := squeezed(" ".join(_texts(p) for p in ElementTree.fromstring(z.read(notes)).iter() if _local(p) == "p"))):
                doc.blocks.append(Block("kv", pairs=[("notes", t)]))
    return doc


TEXT_READERS: dict[str, Callable[[str, str], Document]] = {
    **dict.fromkeys(("md", "markdown", "mdx"), read_markdown), **dict.fromkeys(("htm", "html", "xhtml"), read_html),
    **dict.fromkeys(("csv", "tsv"), read_delimited), **dict.fromkeys(("txt", "log", "mmd"), read_plain),
}
BINARY_READERS: dict[str, Callable[[bytes, str], Document]] = {"docx": read_docx, "xlsx": read_xlsx, "xlsm": read_xlsx, "pptx": read_pptx}


def reader(suffix: str) -> Callable[[bytes, str], Document]:
    s = suffix.lower().lstrip(".")
    if s in BINARY_READERS:
        return BINARY_READERS[s]
    if s in TEXT_READERS:
        return lambda data, name: TEXT_READERS[s](data.decode("utf-8", "replace"), name)
    raise ValueError(f"no reader for .{s}; there are: {', '.join(sorted({*TEXT_READERS, *BINARY_READERS}))} (PDF: give its words as a DataFrame, see operators.spatial)")


def read(path: str) -> Document:
    stem, _, suffix = posixpath.basename(path).rpartition(".")
    with open(path, "rb") as f:
        doc = reader(suffix)(f.read(), stem)
    doc.source = path
    return doc


def block_rows(key, doc: Document) -> Iterator[dict]:
    for pos, b in enumerate(doc.blocks):
        yield {"key": key, "title": doc.title, "pos": pos, **asdict(b), "pairs": [{"k": k, "v": v} for k, v in b.pairs]}


def from_row(r) -> Block:
    get = lambda k, d: d if r[k] is None else r[k]
    return Block(
        r["kind"], get("text", ""), int(get("level", 0)), list(get("items", [])), bool(get("ordered", False)), list(get("cols", [])), [list(x) for x in get("rows", [])],
        get("caption", ""), get("grp", ""), [(p["k"], p["v"]) for p in get("pairs", [])], get("lang", ""), int(get("number", 0)), get("eid", ""), int(get("tokens", 0)), int(get("n_items", 0)),
    )


def block_batches(kind: str, name: str):
    """A function that makes an Arrow batch of (key, title, block) rows."""
    schema = to_arrow_schema(T._parse_datatype_string(f"`{name}` {kind}, title string, pos int, {FIELDS}"))
    fields = [x.split(" ")[0] for x in FIELDS.split(", ")]

    def batch(docs: list[tuple]) -> pa.RecordBatch:
        rows = [(k, d.title, pos, b) for k, d in docs for pos, b in enumerate(d.blocks)]
        columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
        columns += [[[{"k": k, "v": v} for k, v in r[3].pairs] for r in rows] if f == "pairs" else [getattr(r[3], f) for r in rows] for f in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return batch


#: Documents that are parsed before their blocks are sent on.
AT_ONCE = 200


def parsed_blocks(docs: DataFrame, parse: Callable[[str, str], Document], key: str, text: str) -> DataFrame:
    """(key, title, pos, ...): the blocks of each document, by one of the readers."""
    kind = docs.schema[key].dataType.simpleString()

    made = block_batches(kind, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(keys), AT_ONCE):
                yield made([(k, parse(t or "", "")) for k, t in zip(keys[i : i + AT_ONCE], texts[i : i + AT_ONCE], strict=True)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, title string, pos int, {FIELDS}")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, pos, ...): the blocks of all files under a path, each by its suffix; files are read by executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames):
        for f in frames:
            rows = []
            for p, data in zip(f["path"], f["content"], strict=True):
                stem, _, suffix = posixpath.basename(p).rpartition(".")
                rows += block_rows(p, reader(suffix)(bytes(data), stem))
            if rows:
                out = pd.DataFrame(rows).rename(columns={"key": "path"})
                yield out[["path", "title", "pos", *[x.split(" ")[0] for x in FIELDS.split(", ")]]]

    known = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*TEXT_READERS, *BINARY_READERS)
    return files.filter(known).mapInPandas(run, f"path string, title string, pos int, {FIELDS}")

"""Outline of documents: section numbers, what each section holds and costs, and sections on demand."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gneiss.functions.tokens import Counter, words

PREAMBLE = "(preamble)"


class Numbering:
    """Section numbers by effective depth: a heading is a child of the last one above it in level, whatever levels lie
    between, and children are counted by parent, so that no number comes twice."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []  # level and number of the headings that the next one may lie under
        self.children: dict[str, int] = {}

    def next(self, level: int) -> str:
        level = min(level, 6)
        self.open = [x for x in self.open if x[0] < level]
        parent = self.open[-1][1] + "." if self.open else ""
        self.children[parent] = self.children.get(parent, 0) + 1
        name = f"{parent}{self.children[parent]}"
        self.open.append((level, name))
        return name


def number(levels: list[int]) -> list[str]:
    n = Numbering()
    return [n.next(x) for x in levels]


ADDED = "sid string, section string, section_title string, page int, section_pos int"


def outlined(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks, sorted by document and place, with sid (the number of a heading) and ADDED. One shuffle; the sorted rows are
    read as a stream, so that no document has to fit in memory."""
    n = blocks.columns.index("kind"), blocks.columns.index("level"), blocks.columns.index("text"), blocks.columns.index("pos"), blocks.columns.index(key)
    number_at = blocks.columns.index("number") if "number" in blocks.columns else None
    added = T._parse_datatype_string(ADDED)
    kinds = [to_arrow_type(f.dataType) for f in added]
    names = [*blocks.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state, now, page = object(), Numbering(), ("0", PREAMBLE, 1, -1), 1
        for batch in batches:
            kind, level, text, pos, keys = (batch.column(i).to_pylist() for i in n)
            pages = batch.column(number_at).to_pylist() if number_at is not None else [None] * batch.num_rows
            out: list[tuple] = []
            for k, x, t, p, d, m in zip(kind, level, text, pos, keys, pages, strict=True):
                if d != doc:
                    doc, state, now, page = d, Numbering(), ("0", PREAMBLE, 1, -1), 1
                sid = None
                if k == "page" and m is not None:
                    page = m
                elif k == "heading":
                    sid = state.next(x or 1)
                    now = (sid, t, page, p)
                out.append((sid, *now))
            more = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, key).sortWithinPartitions(key, "pos").mapInArrow(run, T.StructType([*blocks.schema.fields, *added.fields]))


def section_ids(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, level, text, sid) of headings. Only headings are shuffled."""
    heads = blocks.filter("kind = 'heading'").select(key, "pos", "kind", "level", "text")
    return outlined(heads, key).select(key, "pos", "level", "text", "sid")


def with_sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with the section they lie in ("0" before the first), its title, place and the page it starts on."""
    return outlined(blocks, key).drop("sid")


def block_cost(count: Counter):
    joined = F.when(F.col("kind").isin("page", "elision", "heading"), F.lit("")).when(F.col("kind") == "list", F.array_join("items", "\n"))
    joined = joined.when(F.col("kind") == "kv", F.array_join(F.transform("pairs", lambda p: F.concat(p["k"], p["v"])), "\n"))
    joined = joined.when(F.col("kind") == "table", F.concat_ws("\n", F.array_join("cols", "\t"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")))
    return count(joined.otherwise(F.coalesce("text", F.lit(""))))


def skeleton(blocks: DataFrame, key: str = "doc_id", count: Counter = words) -> DataFrame:
    """(key, section_pos, section, title, page, tokens, kinds): one row a section; the preamble only if it holds something.
    Blocks are reduced to their costs before they are shuffled."""
    kinds = F.when(F.col("kind") == "table", F.concat(F.lit("table"), F.size("rows").cast("string"), F.lit("x"), F.size("cols").cast("string"))).when(F.col("kind").isin("figure", "code"), F.col("kind"))
    head = F.when(F.col("kind") == "heading", F.col("text"))
    small = blocks.select(key, "pos", "kind", "level", head.alias("text"), "number", block_cost(count).alias("tokens"), kinds.alias("kinds"))
    g = outlined(small, key).groupBy(key, "section_pos", "section", F.col("section_title").alias("title"), "page").agg(F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("kinds")), ",").alias("kinds"))
    return g.filter("section <> '0' or tokens > 0")


def expand(blocks: DataFrame, wanted: list[str] | DataFrame, key: str = "doc_id") -> DataFrame:
    """The blocks of the wanted sections and of the sections below them. wanted: ids for all documents, or rows (key, id),
    which meet the blocks by document and by each prefix of their section."""
    s = with_sections(blocks, key).filter("section <> '0'")
    if isinstance(wanted, DataFrame):
        path = F.split("section", "[.]")
        above = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, 1, n), "."))
        ids = wanted.select(key, F.col("id").alias("_wanted")).groupBy(key).agg(F.collect_set("_wanted").alias("_wanted"))
        s = s.join(ids, key).filter(F.arrays_overlap("_wanted", above)).drop("_wanted")
    else:
        inside = F.lit(False)
        for w in wanted:
            inside = inside | (F.col("section") == w) | F.col("section").startswith(w + ".")
        s = s.filter(inside)
    return s.drop("section_title", "page", "section_pos")


def rendered(skeleton: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, outline): a line for each section, as `id title p{page} ~{tokens}[ kinds]`."""
    more = F.when(F.col("kinds") != "", F.concat(F.lit(" "), F.col("kinds"))).otherwise("")
    line = F.concat(F.col("section"), F.lit(" "), F.col("title"), F.lit(" p"), F.col("page").cast("string"), F.lit(" ~"), F.col("tokens").cast("string"), more)
    lines = F.array_sort(F.collect_list(F.struct("section_pos", line.alias("line"))))
    return skeleton.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("outline"))

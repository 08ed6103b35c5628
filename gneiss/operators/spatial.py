"""Boxes on pages: overlaps, modal sizes, rows and cells of words."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from statistics import fmean, median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tiles along a side at most, so that no box is dealt to more than the square of that.
TILES = 64


def tile_sizes(boxes: DataFrame) -> tuple[float, float]:
    """Sides of the tiles: the mean sides of the boxes, so that those who share a tile mostly overlap."""
    mean = [F.avg(F.col(f"{c}1") - F.col(f"{c}0")) for c in "xy"]
    span = [(F.max(f"{c}1") - F.min(f"{c}0")) / TILES for c in "xy"]
    r = boxes.agg(*[F.greatest(m, s).cast("double").alias(c) for m, s, c in zip(mean, span, "xy", strict=True)]).first()
    return (r.x or 1.0, r.y or 1.0)


def overlaps(left: DataFrame, right: DataFrame, by: list[str], tile: tuple[float, float] | None = None, ordered: bool = False) -> DataFrame:
    """Pairs (by..., l, r) of boxes (id, x0, y0, x1, y1) of one page that overlap; with ordered only those with l < r, for
    the pairs inside one set. Boxes are dealt to the tiles they touch, so that the join is by equality; a pair counts in
    the tile of the overlap's corner only."""
    width, height = tile or tile_sizes(left.unionByName(right) if left is not right else left)

    def dealt(d: DataFrame, name: str) -> DataFrame:
        box = [F.col(c).alias(f"_{name}_{c}") for c in ("id", "x0", "y0", "x1", "y1")]
        t = lambda c, size: F.floor(F.col(c) / size).cast("long")
        tx, ty = F.sequence(t("x0", width), t("x1", width)), F.sequence(t("y0", height), t("y1", height))
        return d.select(*by, *box, F.explode(tx).alias("_tx"), ty.alias("_ty")).withColumn("_ty", F.explode("_ty"))

    a, b = (lambda c: F.col(f"_a_{c}")), (lambda c: F.col(f"_b_{c}"))
    j = dealt(left, "a").join(dealt(right, "b").hint("shuffle_hash"), [*by, "_tx", "_ty"])
    if ordered:
        j = j.filter(a("id") < b("id"))
    j = j.filter((a("x0") < b("x1")) & (b("x0") < a("x1")) & (a("y0") < b("y1")) & (b("y0") < a("y1")))
    first = (F.floor(F.greatest(a("x0"), b("x0")) / width) == F.col("_tx")) & (F.floor(F.greatest(a("y0"), b("y0")) / height) == F.col("_ty"))
    return j.filter(first).select(*by, a("id").alias("l"), b("id").alias("r"))


def body_size(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by..., body): the font size that most characters have, rounded; the smaller of equals."""
    g = spans.groupBy(*by, F.round("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"))
    return g.groupBy(*by).agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))


def leveled(ratio: Column, text: Column) -> Column:
    """The level of a heading by how much larger than the body it is; null for body text and for long text."""
    return F.when(F.length(text) < 160, F.when(ratio >= 1.6, 1).when(ratio >= 1.35, 2).when(ratio >= 1.15, 3))


def heading_levels(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans with the level of heading that their size stands for (null: body)."""
    return spans.join(body_size(spans, by), by).withColumn("level", leveled(F.col("size") / F.col("body"), F.col("text"))).drop("body")


def page_blocks(spans: DataFrame, by: list[str], images: DataFrame | None = None, max_pages: int | None = None) -> DataFrame:
    """(by..., pos, kind, level, text, number): the blocks of paged documents in reading order.

    spans: (by..., page, block, x0, y0, size, text), pieces of text with the block they belong to; images: (by..., page).
    Each page begins with a page mark; its blocks follow from top to bottom, then left to right, as headings by their
    greatest size against the body's or as paragraphs; a page with images ends with one figure.
    """
    pages = spans if max_pages is None else spans.filter(F.col("page") <= max_pages)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda s: s["text"]), " ")
    blocks = pages.groupBy(*by, "page", "block").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("size").alias("size"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))
    level = leveled(F.col("size") / F.col("body"), F.col("text"))
    blocks = blocks.filter("text <> ''").join(body_size(pages, by), by)
    blocks = blocks.select(*by, "page", F.lit(1).alias("rank"), "y0", "x0", "block", F.when(level.isNull(), "para").otherwise("heading").alias("kind"), level.alias("level"), "text")
    none = lambda rank, kind: [F.lit(rank).alias("rank"), *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("y0", "x0", "block")], F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text")]
    out = blocks.unionByName(pages.select(*by, "page").distinct().select(*by, "page", *none(0, "page")))
    if images is not None:
        shown = images if max_pages is None else images.filter(F.col("page") <= max_pages)
        out = out.unionByName(shown.select(*by, "page").distinct().select(*by, "page", *none(2, "figure")))
    order = Window.partitionBy(*by).orderBy("page", "rank", "y0", "x0", "block")
    return out.select(*by, (F.row_number().over(order) - 1).alias("pos"), "kind", "level", "text", F.when(F.col("kind") == "page", F.col("page")).alias("number"))


def islands(df: DataFrame, by: list[str], value: str, gap: float, name: str, order: list[str] | None = None) -> DataFrame:
    """Numbers runs of a sorted value in which no step is over the gap."""
    w = Window.partitionBy(*by).orderBy(value, *(order or []))
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


@dataclass(frozen=True)
class Grid:
    """What makes aligned words a table: distances in points, shares of rows, lengths in characters."""

    row_gap: float = 3.0
    anchor_gap: float = 6.0
    cell_gap: float = 6.0
    widths: float = 2.5
    rows: int = 3
    columns: int = 2
    share: float = 0.75
    median: int = 40
    long: int = 60
    most_long: float = 0.15


def lined(words: list[dict], grid: Grid) -> list[list[dict]]:
    """Words by rows: a row takes the words whose middles lie close to that of its first."""
    middle = lambda w: (w["y0"] + w["y1"]) / 2
    rows: list[list[dict]] = []
    for w in sorted(words, key=lambda w: (middle(w), w["x0"])):
        if rows and abs(middle(w) - middle(rows[-1][0])) <= grid.row_gap:
            rows[-1].append(w)
        else:
            rows.append([w])
    return [sorted(r, key=lambda w: (w["x0"], w["id"])) for r in rows]


def parted(row: list[dict], gap: float) -> list[tuple[float, str]]:
    """The cells of a row, (left edge, text), parted at wide gaps."""
    cells = [[row[0]]]
    for before, w in zip(row, row[1:], strict=False):
        if w["x0"] - before["x1"] >= gap:
            cells.append([])
        cells[-1].append(w)
    return [(c[0]["x0"], " ".join(w["text"] for w in c)) for c in cells]


def aligned(rows: list[list[tuple[float, str]]], grid: Grid) -> list[float] | None:
    """The left edges of the columns, if the rows look like a table. Edges that lie close are one; while there are more
    than most rows have cells, the two nearest become one."""
    counts = Counter(len(r) for r in rows)
    arity = max(counts, key=lambda n: (counts[n], n))
    lengths = [len(t) for r in rows for _, t in r]
    if len(rows) < grid.rows or arity < grid.columns or counts[arity] < grid.share * len(rows):
        return None
    if median(lengths) > grid.median or sum(n > grid.long for n in lengths) >= grid.most_long * len(lengths):
        return None
    clusters: list[list[float]] = []
    for x in sorted(x for r in rows for x, _ in r):
        if clusters and x - clusters[-1][-1] <= grid.anchor_gap:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    while len(clusters) > arity:
        i = min(range(len(clusters) - 1), key=lambda i: fmean(clusters[i + 1]) - fmean(clusters[i]))
        clusters[i : i + 2] = [clusters[i] + clusters[i + 1]]
    anchors = [fmean(c) for c in clusters]
    used = Counter(k for r in rows for k in {nearest(anchors, x) for x, _ in r})
    return anchors if all(used[k] >= grid.share * len(rows) for k in range(len(anchors))) else None


def nearest(anchors: list[float], x: float) -> int:
    return min(range(len(anchors)), key=lambda k: abs(anchors[k] - x))


def page_tables(words: list[dict], grid: Grid = Grid()) -> list[tuple[int, int, int, int, str, float]]:  # noqa: B008
    """(table, row, anchor, cell, text, x0) of the tables without borders on a page: runs of rows of several cells whose
    cells start at common places."""
    if not words:
        return []
    gap = max(grid.cell_gap, grid.widths * median((w["x1"] - w["x0"]) / max(len(w["text"]), 1) for w in words))
    rows = [parted(r, gap) for r in lined(words, grid)]
    out, table, i = [], 0, 0
    while i < len(rows):
        j = i
        while j < len(rows) and len(rows[j]) >= grid.columns:
            j += 1
        if j > i and (anchors := aligned(rows[i:j], grid)):
            out += [(table, r, nearest(anchors, x), c, t, x) for r, row in enumerate(rows[i:j]) for c, (x, t) in enumerate(row)]
            table += 1
        i = max(j, i + 1)
    return out


def borderless_tables(words: DataFrame, by: list[str], grid: Grid = Grid()) -> DataFrame:  # noqa: B008
    """(by..., table, row, anchor, cell, text, x0) of the tables without borders among words (id, x0, y0, x1, y1, text) on
    pages. A page's words are one group; that is what has to fit in a task."""
    columns = ["table", "row", "anchor", "cell", "text", "x0"]

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(page_tables(f[["id", "x0", "y0", "x1", "y1", "text"]].to_dict("records"), grid), columns=columns)
        for name, value in zip(by, key, strict=True):
            out[name] = value
        return out[[*by, *columns]]

    kinds = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in by)
    return words.select(*by, "id", "x0", "y0", "x1", "y1", "text").groupBy(*by).applyInPandas(run, f"{kinds}, table int, row int, anchor int, cell int, text string, x0 double")

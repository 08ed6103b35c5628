"""Embedding near-dedup: int8 tile products with error bounds, full precision for what may pass.

Equal vectors form a class. Each class is scaled to length one and quantised to int8 with a scale of its own; the length
of the quantisation error is kept with it. For unit vectors x = s q + e and y = t r + f the product differs from
s t (q . r) by at most |e| (1 + |f|) + |f| (1 + |e|) + |e| |f|. Only pairs whose product plus this bound reaches the
threshold are computed in double precision.

Classes are dealt to the cells of centres, which are vectors of the table chosen by a hash, and large cells to several tiles.
Tiles lie in blocks of bounded size, each written once as one row; a Cartesian product of these rows, which rereads
what is written and shuffles nothing, brings all pairs of blocks together. A tile is cut into bands by the angle to its
centre. If all of a band lies within an angle r of the centre, then a vector that reaches the threshold with any of it lies
within r plus the threshold's angle of that centre; of each pair of bands only the vectors that both allow are multiplied. So no pair is lost, whatever the vectors,
and the disk grows with the input. Vectors in no clusters and of many dimensions are hardly left out: then the work grows
with the square of the number of different vectors (as an exact answer for arbitrary vectors needs), spread over as many
tasks as there are pairs of files. A pair of blocks returns a number of links for each class and the edges of a spanning
forest, never its pairs.

A vector that is null, empty or zero, or has null or non-finite components links with nothing, nor do vectors of different
lengths. Vectors whose ids repeat are separate rows. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import tokens as tk
from gneiss.llm.common import Scratch, components

THRESHOLD = 0.95
TILE = 4096
#: Centres of a dimension at most, and numbers in them; distinct vectors of a cell from which its size is estimated.
CENTRES = 4096
CENTRE_NUMBERS = 4_000_000
SAMPLE = 64
#: Rows of a band of a tile, which lie at similar angles to its centre.
BAND = 1024
#: Bytes and tiles of a block at most, and blocks that smaller tables are dealt to.
BLOCK = 32_000_000
TILES = 256
BLOCKS = 12
#: Rows of a tile that are compared at once, pairs computed in double precision at once, and links that are held.
STRIPE = 512
PAIRS = 16_384
LINKS = 1_000_000
#: Covers the rounding of scales and products in single precision.
SLACK = 1e-5


def digests(vectors: pa.ListArray) -> pa.Array:
    """The digest of each vector, null where it links with nothing."""
    size = vectors.value_lengths().fill_null(0).to_numpy()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # nulls become NaN
    end = np.cumsum(size, dtype=np.int64)
    count = lambda y: np.concatenate(([0], np.cumsum(y)))
    odd, some = count(~np.isfinite(x)), count(x != 0)
    ok = (odd[end] == odd[end - size]) & (some[end] > some[end - size])
    raw = x.tobytes()
    return pa.array([hashlib.blake2b(raw[8 * (z - n) : 8 * z], digest_size=16).digest() if k else None for z, n, k in zip(end.tolist(), size.tolist(), ok.tolist(), strict=True)], pa.binary())


def class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the digest of their vector (null: the vector links with nothing)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), digests(batch.column("embedding"))], ["vec_id", "cls"])


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, int8 codes as single-precision numbers, scales, bounds of the error's length."""
    x = unit(x)
    scale = np.abs(x).max(1, keepdims=True) / 127
    code = np.rint(x / scale).astype(np.int8)
    error = np.sqrt(((x - code * scale) ** 2).sum(1)) * (1 + 1e-9)
    return x, code.astype(np.float32), scale[:, 0].astype(np.float32), error


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps tiny and huge vectors from under- and overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def products(x: np.ndarray, a: tuple, y: np.ndarray, b: tuple, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of a and b that reach the threshold, by stripes. x, y: vectors; a, b: rows of them, codes, scales, errors."""
    (m, q, s, e), (n, r, t, f) = a, b
    worst, top = f.max(), t.max()
    least = ((threshold - (e * (1 + worst) + worst * (1 + e) + e * worst) - SLACK) / s).astype(np.float32)
    rt = np.ascontiguousarray(r.T)  # sums of products of codes are exact: 127 * 127 * 1024 < 2 ** 24
    wide, units = 1024, None
    for i in range(0, len(m), STRIPE):
        g = sum(q[i : i + STRIPE, k : k + wide] @ rt[k : k + wide] for k in range(0, x.shape[1], wide))
        low = least[i : i + STRIPE]
        row = np.flatnonzero((low <= 0) | (g.max(1) * top * (1 + SLACK) >= low))
        if not len(row):
            continue
        u, v = np.nonzero(g[row] * t >= low[row, None])
        u = row[u] + i
        if same:
            u, v = u[u < v], v[u < v]
        for k in range(0, len(u), PAIRS):
            units = units or (unit(x[m]), unit(y[n]))
            c, d = u[k : k + PAIRS], v[k : k + PAIRS]
            ok = np.einsum("ij,ij->i", units[0][c], units[1][d]) >= threshold
            yield m[c[ok]], n[d[ok]]


class Block:
    """Bands side by side, as a row of the written table holds them."""

    def __init__(self, row: dict[str, pa.Scalar], side: str):
        at = lambda c, t: np.frombuffer(row[f"{c}_{side}"].as_buffer(), t)
        self.id, dim = row[f"block_{side}"].as_py(), row["dim"].as_py()
        self.scale, self.error, self.mult, self.cuts, self.radius, self.of = at("scale", np.float32), at("error", np.float64), at("mult", np.int64), at("cuts", np.int64), at("radius", np.float64), at("of", np.int64)
        self.n = len(self.mult)
        self.x = at("vectors", f"f{row[f'vectors_{side}'].as_buffer().size // (self.n * dim)}").reshape(self.n, dim)
        self.code, self.cls = at("codes", np.int8).reshape(self.n, dim).astype(np.float32), at("cls", "V16")
        self.centre = at("centres", np.float64).reshape(-1, dim).astype(np.float32)

    def to(self, other: Block) -> np.ndarray:
        """By centre of the other block and row of this one: a bound of their product."""
        got = other.centre @ self.code.T
        got *= self.scale
        got += (self.error + SLACK + 1e-7 * self.x.shape[1]).astype(np.float32)  # scales and products are rounded
        return got

    def least(self, angle: float) -> np.ndarray:
        """By band: the product with its centre that a vector needs to reach the threshold with any of it."""
        return np.cos(np.minimum(self.radius + angle, np.pi)) - SLACK

    def rows(self, k: np.ndarray) -> tuple:
        return k, self.code[k], self.scale[k], self.error[k]


def block_links(a: Block, b: Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of a and, if that is another block, of b; the smallest row each reaches; the classes."""
    same = a.id == b.id
    angle = math.acos(min(max(threshold, -1), 1))
    base = 0 if same else a.n
    mult, cls = (a.mult, a.cls) if same else (np.concatenate((a.mult, b.mult)), np.concatenate((a.cls, b.cls)))
    links, low = np.zeros(len(mult), np.int64), np.arange(len(mult))
    to_b, to_a, least_a, least_b = a.to(b), b.to(a), a.least(angle), b.least(angle)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal low
        if held:
            low = tk.forest(len(low), *(low[np.concatenate(z)] for z in zip(*held, strict=True)))[low]
            held.clear()

    size = 0
    for i in range(len(a.radius)):
        p, end = a.cuts[i], a.cuts[i + 1]
        for j in range(i if same else 0, len(b.radius)):
            z = b.cuts[j]
            if one := same and i == j:
                m = n = np.arange(p, end)
            else:
                m = p + np.flatnonzero(to_b[b.of[j], p:end] >= least_b[j])
                n = z + np.flatnonzero(to_a[a.of[i], z : b.cuts[j + 1]] >= least_a[i])
            if not len(m) or not len(n):
                continue
            for u, v in products(a.x, a.rows(m), b.x, b.rows(n), one, threshold):
                v = v + base
                np.add.at(links, u, mult[v])
                np.add.at(links, v, mult[u])
                held.append((u, v))
                size += len(u)
                if size > LINKS:
                    fold()
                    size = 0
    fold()
    return links, low, cls


def pair_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                a = Block(row, "a")
                b = a if row["block_a"].as_py() == row["block_b"].as_py() else Block(row, "b")
                links, low, cls = block_links(a, b, threshold)
                k = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in cls[k]], pa.binary()), pa.array([x.tobytes() for x in cls[low[k]]], pa.binary()), pa.array(links[k])], ["cls", "root", "links"])

    return run


class Layout:
    """Of each dimension the centres, the first tile and the number of tiles of each cell, and the block of each tile."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres, self.band = centres, BAND
        self.cells: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.blocks: list[int] = []

    def deal(self, sizes: dict[int, np.ndarray], width: int) -> int:
        """Deals cells of these sizes to tiles and blocks; returns the number of blocks."""
        blocks: list[int] = []
        block = -1
        for d, size in sorted(sizes.items()):
            parts = np.ceil(np.maximum(size, 1) / TILE).astype(np.int64)
            self.cells[d] = np.cumsum(parts) - parts + len(blocks), parts
            most = min(BLOCK // (d * (width + 1) + 40), max(TILE, math.ceil(size.sum() / BLOCKS)))
            held, tiles = math.inf, 0
            for n in np.repeat(size / parts, parts).tolist():
                if held + n > most or tiles == TILES:
                    block, held, tiles = block + 1, 0, 0
                blocks.append(block)
                held += n
                tiles += 1
        self.blocks = blocks
        return block + 1

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each row."""
        c = self.centres.get(x.shape[1])
        if c is None or not len(x):
            return np.zeros(len(x), np.int64)
        ct, step = np.ascontiguousarray(c.T, np.float32), max(1, 2_000_000 // len(c))
        return np.concatenate([(unit(x[i : i + step]).astype(np.float32) @ ct).argmax(1) for i in range(0, len(x), step)])


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Vectors of one dimension that may link, their digests, and their rows."""
    cls = batch.column("cls") if "cls" in batch.schema.names else digests(batch.column("embedding"))
    keep = cls.is_valid()
    cls, batch = cls.filter(keep), batch.filter(keep)
    dims = batch.column("embedding").value_lengths().to_numpy()
    for d in np.unique(dims).tolist():
        k = pa.array(np.flatnonzero(dims == d))
        rows = batch.take(k)
        x = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        yield x if x.dtype == np.float32 else x.astype(np.float64), np.array(cls.take(k).to_pylist(), "V16"), rows


def cell_batches(layout: Layout):
    """How many vectors of each batch lie in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, *_ in by_dimension(batch):
                cell, n = np.unique(layout.cell(x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), x.shape[1], np.int32)), pa.array(cell), pa.array(n)], ["dim", "cell", "n"])

    return run


def placed_batches(layout: Layout):
    """Different vectors with their digests, blocks and tiles; those that link with nothing go."""
    block = np.array(layout.blocks, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, cls, rows in by_dimension(batch):
                first, parts = layout.cells[x.shape[1]]
                cell = layout.cell(x)
                part = (cls.view("<u8").reshape(-1, 2)[:, 0] % parts[cell].astype(np.uint64)).astype(np.int64)
                tile = first[cell] + part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[tile]), pa.array(tile.astype(np.int32)), pa.array([c.tobytes() for c in cls], pa.binary()), rows.column("embedding"), rows.column("mult")],
                    ["block", "tile", "cls", "embedding", "mult"],
                )

    return run


BLOCK_BINARY = ["vectors", "codes", "scale", "error", "cls", "mult", "cuts", "radius", "of", "centres"]


def block_batches(layout: Layout):
    """A row for each block of rows that are sorted by block and tile."""
    firsts = {d: first for d, (first, _) in layout.cells.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), t in tk.groups(batches, 1):
            (x, cls, rows), = by_dimension(t.combine_chunks().to_batches()[0])
            d = x.shape[1]
            tile, c = rows.column("tile").to_numpy(), layout.centres.get(d)
            names, of = np.unique(tile, return_inverse=True)
            centre = np.zeros((len(names), d)) if c is None else c[np.searchsorted(firsts[d], names, "right") - 1]
            cosine = np.einsum("ij,ij->i", unit(x), centre[of])
            order = np.lexsort((-cosine, of))
            x, cls, mult, of, cosine = x[order], cls[order], rows.column("mult").to_numpy()[order], of[order], cosine[order]
            y, code, scale, error = pack(x)
            sizes = np.bincount(of)
            cuts = np.concatenate([z - n + np.arange(0, n, layout.band) for z, n in zip(np.cumsum(sizes), sizes, strict=True)] + [[len(x)]]).astype(np.int64)
            # without centres nothing is left out
            radius = np.full(len(cuts) - 1, np.pi) if c is None else np.arccos(np.clip(cosine[cuts[1:] - 1], -1, 1))
            values = [x, code.astype(np.int8), scale, error, cls, mult, cuts, radius, of[cuts[:-1]].astype(np.int64), centre]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([d], pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values)], ["block", "dim", *BLOCK_BINARY])

    return run


def laid_out(v: DataFrame) -> tuple[Layout, int]:
    """Centres and blocks for the vectors. The driver holds the centres and the estimated size of each cell."""
    count = {r.dim: r.n for r in v.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row a dimension
    centres, rate = {}, {}
    draw = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    for d, n in count.items():
        k = min(math.ceil(n / TILE), CENTRES, max(CENTRE_NUMBERS // d, 1))
        rate[d] = min(1.0, SAMPLE * k / n)
        if k > 1:
            few = v.filter((F.size("embedding") == d) & (draw < int((1 << 30) * k / n) + 1)).select("embedding").distinct().toArrow().combine_chunks()
            found = [unit(x) for b in few.to_batches() for x, *_ in by_dimension(b)]
            if found:
                centres[d] = np.unique(np.concatenate(found), axis=0)
    layout = Layout(centres)
    size = {d: np.full(1, n, np.float64) for d, n in count.items() if d not in centres} | {d: np.zeros(len(c)) for d, c in centres.items()}
    if centres:
        chosen = F.lit(False)
        for d in centres:
            chosen = chosen | ((F.size("embedding") == d) & (draw < int((1 << 30) * rate[d]) + 1))
        cells = v.filter(chosen).select("embedding").distinct().mapInArrow(cell_batches(layout), "dim int, cell bigint, n bigint").groupBy("dim", "cell").agg(F.sum("n").alias("n"))
        for r in cells.collect():  # one row a cell
            size[r.dim][r.cell] = r.n / rate[r.dim]
    return layout, layout.deal(size, 4 if v.schema["embedding"].dataType.elementType.simpleString() == "float" else 8)


def link_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    scratch = Scratch(spark)
    v = vectors.select("vec_id", "embedding")
    kind = v.schema["vec_id"].dataType.simpleString()
    rows = scratch.write(v.mapInArrow(class_batches, f"vec_id {kind}, cls binary"))
    # equal vectors meet as arrays, aggregated before the shuffle; the digest names the class
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("mult"), F.min("vec_id").alias("first"))
    classes = scratch.write(classes)
    layout, n = laid_out(v)
    placed = v.groupBy("embedding").agg(F.count("*").alias("mult")).filter(F.size("embedding") > 0)
    placed = placed.mapInArrow(placed_batches(layout), f"block int, tile int, cls binary, embedding {v.schema['embedding'].dataType.simpleString()}, mult bigint")
    placed = placed.repartition(max(n, 1), "block").sortWithinPartitions("block", "tile")
    blocks = scratch.write(placed.mapInArrow(block_batches(layout), "block int, dim int, " + ", ".join(f"{c} binary" for c in BLOCK_BINARY)))
    side = lambda s: blocks.select("dim", *(F.col(c).alias(f"{c}_{s}") for c in ("block", *BLOCK_BINARY)))
    a, b = side("a"), side("b").withColumnRenamed("dim", "dim_b")
    pairs = a.hint("shuffle_replicate_nl").join(b, (F.col("dim") == F.col("dim_b")) & (F.col("block_a") <= F.col("block_b"))).drop("dim_b")
    links = scratch.write(pairs.mapInArrow(pair_batches(threshold), "cls binary, root binary, links bigint"))
    scratch.drop(blocks)
    comp = components(scratch, links.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    known = classes.join(links.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left").join(comp, F.col("cls") == F.col("node"), "left")
    known = scratch.write(known.select("cls", "mult", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("group")))
    low = scratch.write(known.groupBy("group").agg(F.min("first").alias("component_id")))
    known = scratch.write(known.join(low, "group").select("cls", (F.col("links") + F.col("mult") - 1).alias("n_links"), "component_id"))
    out = rows.join(known, "cls", "left")
    root = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col("vec_id")).alias("kept"))

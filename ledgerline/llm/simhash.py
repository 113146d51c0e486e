"""Near-duplicates by SimHash, linked through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the segments (0 to 2 each) are a point, and
the Manhattan distance of two points is at most the Hamming distance of the fingerprints. The 32 axes form eight groups.
Where the Manhattan distance is 4 or less, at least four of the eight groups agree on all their counts. So a point
enters the 70 grid cells given by four groups and their counts, two points within range share a cell, and only what
shares a cell is held against the bound and then compared bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, text_or_empty, within, wrapped
from .components import connected_components

RADIUS = 4
GROUPS = 8
COMBOS = list(combinations(range(GROUPS), GROUPS - RADIUS))
#: Cells with more points are compared in slabs, pair of slabs by pair of slabs, each a task of its own.
SLAB = 8192


def _first_combos() -> np.ndarray:
    """For a mask of agreeing groups, the first combination within it (or none: 255)."""
    out = np.full(1 << GROUPS, 255, np.uint8)
    for mask in range(1 << GROUPS):
        for i, c in enumerate(COMBOS):
            if all(mask >> g & 1 for g in c):
                out[mask] = i
                break
    return out


FIRST = _first_combos()


def simhash(text: str, shingle: int = 4, block: int = 1 << 16) -> int:
    """The fingerprint of a whole text, over all its shingles with repeats, taken in blocks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), block):
        h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[i : i + block], ends[i : i + block], strict=True)), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def embed(fp: np.ndarray) -> np.ndarray:
    """The 32 segment counts of each fingerprint, in two bits each."""
    low = np.uint64(0x5555555555555555)
    return (fp & low) + ((fp >> np.uint64(1)) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: |x - y| per two-bit field is the bit count of their unary codes' difference."""
    low, one = np.uint64(0x5555555555555555), np.uint64(1)

    def unary(x):  # 0, 1, 2 as 00, 01, 11
        high = (x >> one) & low
        return (x & low) | high | (high << one)

    return np.bitwise_count(unary(a) ^ unary(b))


def _fingerprints(batches):
    for b in batches:
        fp = np.array([simhash(x.as_py()) for x in b.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "_row", "fp"])


def _cells(batches):
    """Each point once for every grid cell it lies in."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        groups = embed(fp.view(np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        for i, combo in enumerate(COMBOS):
            cell = np.full(len(fp), i, np.int64)
            for g in combo:
                cell = (cell << 8) | groups[:, g]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp)], names=["cell", "fp"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs link: the Manhattan bound first, the bits of those within it then."""
    a, b = np.broadcast_arrays(a, b)
    ok = manhattan(embed(a), embed(b)) <= RADIUS
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= RADIUS
    return ok


def _reached(front: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """left split into what links with a point of front and what doesn't."""
    found = [left[:0]]
    step = max(1, (1 << 20) // len(left))
    for i in range(0, len(front), step):
        if not len(left):
            break
        hit = near(front[i : i + step, None], left[None, :]).any(0)
        found.append(left[hit])
        left = left[~hit]
    return np.concatenate(found), left


def spanning(fp: np.ndarray, other: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join what links within fp, or between fp and other (there along links of one side's point with one of
    the other's, to and fro): each point is reached once, so edges stay linear."""
    out = []
    # What isn't reached yet, of the side to look in and the side of the front; within fp both are one.
    sides = [fp] if other is None else [fp, other]
    while len(sides[0]) > (other is None) and len(sides[-1]):
        root, front, at = sides[0][:1], sides[0][:1], 0
        sides[0] = sides[0][1:]
        while len(front):
            at = (at + 1) % len(sides)
            if not len(sides[at]):
                break
            front, sides[at] = _reached(front, sides[at])
            if len(front):
                out.append((front, np.repeat(root, len(front))))
    return out


def _edges(cells: np.ndarray, fps: np.ndarray):
    """Edges within whole cells (sorted by cell). Cells of few points pair by pair, all at once; others by spanning()."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, len(cells)])
    u, v = [], []
    few = (sizes > 1) & (sizes <= 8)
    for gap in range(1, 8):
        for size in range(gap + 1, 9):
            at = starts[few & (sizes == size)]
            if len(at):
                i = (at[:, None] + np.arange(size - gap)).ravel()
                a, b = fps[i], fps[i + gap]
                ok = near(a, b)
                a, b, c = a[ok], b[ok], cells[i][ok] >> 32
                same = (embed(a).astype("<u8").view(np.uint8) == embed(b).astype("<u8").view(np.uint8)).reshape(-1, 8)
                ok = FIRST[np.packbits(same, axis=1, bitorder="little")[:, 0]] == c  # the first cell they share tells of them
                u.append(a[ok]), v.append(b[ok])
    for i in np.flatnonzero(sizes > 8):
        for a, b in spanning(fps[starts[i] : starts[i] + sizes[i]]):
            u.append(a), v.append(b)
    if u:
        yield _links(np.concatenate(u), np.concatenate(v))


def _links(u, v, cell=None, slab=None) -> pa.RecordBatch:
    n = len(u)
    cell = pa.nulls(n, pa.int64()) if cell is None else pa.array(np.full(n, cell, np.int64))
    slab = pa.nulls(n, pa.int64()) if slab is None else pa.array(np.full(n, slab, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), cell, slab], names=["u", "v", "cell", "slab"])


def _within(batches):
    """Rows (cell, fp) sorted by cell, to edges. A cell of more than SLAB points is handed on, numbered by slab."""
    held_c, held_f, hot, slab = np.empty(0, np.int64), np.empty(0, np.uint64), None, 0
    for b in batches:
        held_c = np.concatenate([held_c, b.column(0).to_numpy(zero_copy_only=False)])
        held_f = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if hot is not None:
            n = int(np.searchsorted(held_c, hot, "right"))
            while n >= SLAB or (n and n < len(held_c)):
                part, held_f, held_c = held_f[: min(n, SLAB)], held_f[min(n, SLAB) :], held_c[min(n, SLAB) :]
                yield _links(part, part, hot, slab)
                n, slab = n - len(part), slab + 1
            if len(held_c) and held_c[0] != hot:
                hot = None
        if not len(held_c) or hot is not None:
            continue
        cut = int(np.searchsorted(held_c, held_c[-1], "left"))
        if cut:
            yield from _edges(held_c[:cut], held_f[:cut])
            held_c, held_f = held_c[cut:], held_f[cut:]
        if len(held_c) > SLAB:
            hot, slab = int(held_c[0]), 1
            yield _links(held_f[:SLAB], held_f[:SLAB], hot, 0)
            held_c, held_f = held_c[SLAB:], held_f[SLAB:]
    if hot is not None and len(held_c):
        yield _links(held_f, held_f, hot, slab)
    elif len(held_c):
        yield from _edges(held_c, held_f)


def _slab_pair(key, pdf):
    import pandas as pd

    _, i, j = key
    a = pdf.loc[pdf.slab == i, "u"].to_numpy().view(np.uint64)
    found = spanning(a) if i == j else spanning(a, pdf.loc[pdf.slab == j, "u"].to_numpy().view(np.uint64))
    u = np.concatenate([x for x, _ in found] or [np.empty(0, np.uint64)]).view(np.int64)
    v = np.concatenate([x for _, x in found] or [np.empty(0, np.uint64)]).view(np.int64)
    return pd.DataFrame({"u": u, "v": v})


def hot_cell_links(spark: SparkSession, handed: DataFrame) -> DataFrame:
    """Edges of the cells that were handed on: every pair of slabs is a group of at most two slabs' points."""
    count = handed.groupBy("cell").agg((F.max("slab") + 1).alias("slabs"))
    sides = handed.join(count, "cell").select("cell", "u", "slab", F.explode(F.expr("sequence(0L, slabs - 1)")).alias("other"))
    sides = sides.withColumn("i", F.least("slab", "other")).withColumn("j", F.greatest("slab", "other"))
    return sides.select("cell", "i", "j", "u", "slab").groupBy("cell", "i", "j").applyInPandas(_slab_pair, "u long, v long")


def near_links(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that join all that differ in at most four bits."""
    cells = classes.select("fp").mapInArrow(_cells, "cell long, fp long")
    links = cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_within, "u long, v long, cell long, slab long")
    links = materialise(spark, links, "links")
    edges = links.where("cell is null").select("u", "v")
    handed = links.where("cell is not null")
    if handed.isEmpty():
        return edges
    return edges.union(hot_cell_links(spark, handed.select("cell", "u", "slab")))


def grouped(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """doc_id, _row, fp, root (the least fingerprint of the component), component_id."""
    ship(spark)
    row = F.col(row_col) if row_col else F.lit(0).cast("long")
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("_row"), text_or_empty(text_col).alias("_text"))
    prints = materialise(spark, prints.mapInArrow(_fingerprints, "doc_id long, _row long, fp long"), "prints")
    classes = materialise(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = connected_components(spark, near_links(spark, classes))
    linked = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    known = classes.join(linked, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    known = materialise(spark, known, "known")
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = materialise(spark, known.join(least, "root").select("fp", "root", "component_id"), "known")
    return prints.join(known, "fp")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of anything but ASCII white space, A-Z in lower case; a shingle is four words, fewer words are one
    shingle. Fingerprints that differ in at most four bits link, and component_id is the smallest doc_id reachable,
    the document's own included. A null text counts as empty; texts without words have fingerprint zero and link like
    any other. A null doc_id never is a component_id unless its component holds no other. Rows that repeat a doc_id
    keep a row each; an empty table gives an empty result; further columns are ignored whatever their names.
    """
    found = grouped(spark, docs, id_col, text_col, None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (its first row, if rows repeat it). A
    component without any doc_id keeps its first row. All columns stay, whatever their names."""
    held = materialise(spark, wrapped(docs), "docs")
    found = grouped(spark, within(held, f"doc_id={id_col}", f"text={text_col}"), "doc_id", "text", "_row")
    found = materialise(spark, found.select("doc_id", "_row", "root", "component_id"), "near")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_row").alias("_row"))
    gone = found.join(first.select("_row"), "_row", "left_anti").select("_row")
    return held.join(gone, "_row", "left_anti").select("_doc.*")

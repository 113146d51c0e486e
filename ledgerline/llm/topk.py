"""Exact top-k by inner product over a bit-sliced index of quantised vectors.

Vectors are quantised to integers. A block of rows keeps, for every component, one bitmap over the rows for each binary
digit. The scores of all rows of a block for a query are added as bitmaps: every set digit of a query component sends
the component's bitmaps to their places, and carry-save adders reduce the bitmaps at each place to one. The k best rows
are then selected from the most significant bitmap downward; rows that tie at the end are resolved by their number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, ship, shuffle_partitions

#: Rows of a block, and queries that are sent to the executors at once.
BLOCK, QUERIES = 8192, 16_384
LONG = (1 << 63) - 1


def _bitmap(flags: np.ndarray) -> np.ndarray:
    """Booleans along the last axis to words of 64 bits."""
    pad = -flags.shape[-1] % 64
    flags = np.concatenate([flags, np.zeros((*flags.shape[:-1], pad), bool)], axis=-1) if pad else flags
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(flags), axis=-1, bitorder="little")).view("<u8")


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class BitSlicedBlock:
    """The index of up to BLOCK rows; values is rows x components, rows in the order in which ties are to be resolved."""

    def __init__(self, values: np.ndarray):
        self.rows, self.width = values.shape
        self.least = int(values.min(initial=0))
        spread = int(values.max(initial=0)) - self.least
        self.digits = max(1, spread.bit_length())
        self.mask = (1 << self.digits) - 1
        lifted = (values - self.least).astype(np.uint64).T  # components x rows
        self.slices = np.stack([_bitmap((lifted >> np.uint64(b)) & np.uint64(1) != 0) for b in range(self.digits)], axis=1)
        self.valid = _bitmap(np.ones(self.rows, bool))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the scores by place, and what is to be added to each."""
        q = query[: self.width]
        size = np.abs(q)
        # A negative component counts its complement instead, so that only additions occur.
        x = np.where((q < 0)[:, None, None], ~self.slices[: len(q)], self.slices[: len(q)])
        shift = self.least * int(q.sum()) - self.mask * int(size[q < 0].sum())
        places: list[list[np.ndarray]] = []
        for j in range(int(size.max(initial=0)).bit_length()):
            some = x[(size >> j) & 1 != 0]
            for b in range(self.digits if len(some) else 0):
                while len(places) <= j + b:
                    places.append([])
                places[j + b].append(some[:, b])
        out = []
        p = 0
        while p < len(places):
            at = np.concatenate(places[p]) if places[p] else np.zeros((1, len(self.valid)), np.uint64)
            if len(at) > 1 and p + 1 == len(places):
                places.append([])
            while len(at) > 2:
                t = len(at) // 3
                a, b, c = at[:t], at[t : 2 * t], at[2 * t : 3 * t]
                half = a ^ b
                places[p + 1].append((a & b) | (c & half))
                at = np.concatenate([half ^ c, at[3 * t :]])
            if len(at) == 2:
                places[p + 1].append(at[:1] & at[1:])
                at = at[:1] ^ at[1:]
            out.append(at[0])
            p += 1
        return out, shift

    def top(self, query: np.ndarray, k: int, but: int | None = None) -> list[tuple[int, int]]:
        """(score, row) of the k best rows, row `but` left out; of equal scores the smaller row numbers."""
        slices, shift = self.scores(query)
        open_ = self.valid.copy()
        if but is not None:
            open_[but // 64] &= ~np.uint64(1 << (but % 64))
        sure, need = np.zeros_like(open_), k
        for s in reversed(slices):
            ones = open_ & s
            n = _count(ones)
            if n >= need:
                open_ = ones
            else:
                sure |= ones
                need -= n
                open_ = open_ & ~s
        rows = np.concatenate([_rows(sure), _rows(open_)[:need]])
        found = []
        for r in rows.tolist():
            w, bit = r // 64, r % 64
            found.append((sum(int(s[w]) >> bit & 1 and 1 << p for p, s in enumerate(slices)) + shift, r))
        return sorted(found, key=lambda x: (-x[0], x[1]))


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _search(batches, queries: list[tuple[int, int, np.ndarray]], k: int):
    """Rows (vec_id, row, q) of a partition, block by block, to its best k for each query."""
    best: dict[int, list] = {row: [] for _, row, _ in queries}

    def block(rows: list[tuple]) -> None:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        width = max(len(r[2]) for r in rows)
        values = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            values[i, : len(r[2])] = r[2]
        index, place = BitSlicedBlock(values), {r[1]: i for i, r in enumerate(rows)}
        for _, row, q in queries:
            heap = best[row]
            for score, i in index.top(q, k, place.get(row)):
                item = (score, rows[i][0] is not None, -(rows[i][0] or 0), rows[i][1])
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)

    held: list[tuple] = []
    for b in batches:
        held += zip(*(c.to_pylist() for c in b.columns), strict=True)
        while len(held) >= BLOCK:
            block(held[:BLOCK])
            held = held[BLOCK:]
    if held:
        block(held)
    for i in range(0, len(queries), 1024):
        out = [(qid, row, -v if known else None, max(-LONG, min(LONG, s))) for qid, row, _ in queries[i : i + 1024] for s, known, v, _ in best[row]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "query_row", "vec_id", "score"])


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, row and the components as floor(scale * x); rows with a null or non-finite component are left out."""
    x = F.col("v")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    held = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vector_col).cast("array<double>").alias("v"))
    return held.where(x.isNotNull() & ~bad).select("vec_id", "row", F.transform(x, lambda c: F.floor(c * scale)).alias("q"))


def top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (a Column of vec_id) holds, the k best others.

    The score is the integer inner product of quantised vectors, the shorter one filled up with zeros; ties go to the
    smaller vec_id, a null one last. Only the query's own row is left out, so a row that repeats its vec_id is found.
    Vectors that are null or hold null or non-finite components take no part. An empty table gives no rows. Components
    are exact while scale * x is below 2**53; a score beyond a long is the nearest long.

    Queries go to the executors QUERIES at a time, so what is broadcast is bounded; each such block is one pass over
    the index, and its result is written before the next one begins.
    """
    ship(spark)
    rows = materialise(spark, quantised(vectors, id_col, vector_col, scale).repartition(shuffle_partitions(spark), "row"), "quantised")
    asked = rows.where(is_query)
    passes = max(1, -(-asked.count() // QUERIES))
    parts = []
    for i in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).collect()
        sent = spark.sparkContext.broadcast([(r.vec_id, r.row, np.array(r.q, np.int64)) for r in mine])
        own = rows.mapInArrow(lambda batches, sent=sent: _search(batches, sent.value, k), "query_id long, query_row long, vec_id long, score long")
        parts.append(materialise(spark, own, "found"))
        sent.destroy()  # what this pass found is written
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

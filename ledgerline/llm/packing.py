"""Hierarchical packing of tokenised documents into context windows of several sizes.

Tiers are the powers of two from ``LEAST`` to ``MOST`` tokens. A document longer than the longest window first yields
whole windows; what remains is routed to the smallest tier that holds it and opens a window there. Tiers are packed
from the longest down: the gap of a window is filled with remainders of shorter tiers, the longest that fits first,
and where none fits one is cut at the edge and its rest put back in its own tier. So each closed window is full, at a
power of two, without padding; only what a partition has left at its end is split into ever shorter full windows and at
most one window under ``LEAST`` tokens, the only one to be padded. Windows are dealt to step groups of equal tokens.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, text_or_empty
from .tokenizing import WordTokenizer

MOST, LEAST = 4096, 256
END = 2
#: Tokens of remainders that a partition holds before it packs them, and tokens of a step group.
POOL, STEP = 1 << 21, 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: doc_id, start, ids, tokens of the document
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Packs the documents of one partition; emit gets (pieces of a window, tier)."""

    def __init__(self, emit: Callable[[list[Piece], int], None]):
        self.emit, self.pool, self.tokens = emit, {t: [] for t in self.tiers()}, 0

    @staticmethod
    def tiers() -> list[int]:
        return [1 << k for k in range(LEAST.bit_length() - 1, MOST.bit_length())]

    @staticmethod
    def tier(tokens: int) -> int:
        return max(LEAST, 1 << (tokens - 1).bit_length())

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total // MOST * MOST
        for s in range(0, whole, MOST):
            self.emit([(doc_id, s, ids[4 * s : 4 * (s + MOST)], total)], MOST)
        if total > whole:
            self.put((doc_id, whole, ids[4 * whole :], total))
            if self.tokens >= POOL:
                self.pack(False)

    def put(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        self.pool[self.tier(n)].append(piece)
        self.tokens += n

    def take(self, tier: int) -> Piece:
        piece = self.pool[tier].pop()
        self.tokens -= len(piece[2]) // 4
        return piece

    def filler(self, gap: int) -> Piece | None:
        """The piece for a gap: one of the longest tier that surely fits, else the shortest there is."""
        fit = [t for t in self.pool if self.pool[t] and t <= gap]
        any_ = [t for t in self.pool if self.pool[t]]
        return self.take(max(fit)) if fit else self.take(min(any_)) if any_ else None

    def pack(self, last: bool) -> None:
        for tier in reversed(self.pool):
            self.pool[tier].sort(key=lambda p: (len(p[2]), p[1]))
        for tier in reversed(self.pool):
            while self.pool[tier]:
                if not last and self.tokens < MOST:
                    return
                head = self.take(tier)
                window, gap = [head], tier - len(head[2]) // 4
                while gap:
                    piece = self.filler(gap)
                    if piece is None:
                        break
                    doc_id, start, ids, total = piece
                    if len(ids) // 4 > gap:
                        self.put((doc_id, start + gap, ids[4 * gap :], total))
                        ids = ids[: 4 * gap]
                    window.append((doc_id, start, ids, total))
                    gap -= len(ids) // 4
                if gap:
                    self.rest(window)
                else:
                    self.emit(window, tier)

    def rest(self, window: list[Piece]) -> None:
        """The last pieces of a partition, too few for their tier: full windows of shorter tiers, then one padded."""
        left = sum(len(p[2]) // 4 for p in window)
        while left:
            size = 1 << (left.bit_length() - 1) if left >= LEAST else left
            part, need = [], size
            while need:
                doc_id, start, ids, total = window.pop(0)
                if len(ids) // 4 > need:
                    window.insert(0, (doc_id, start + need, ids[4 * need :], total))
                    ids = ids[: 4 * need]
                part.append((doc_id, start, ids, total))
                need -= len(ids) // 4
            self.emit(part, size if size >= LEAST else MOST)
            left -= size


class StepGroups:
    """Deals windows of one tier to groups of STEP tokens, so that steps are equally long; ids are the partition's own."""

    def __init__(self):
        self.open, self.next = {}, 0

    def group(self, tier: int) -> int:
        number, tokens = self.open.get(tier, (None, STEP))
        if tokens + tier > STEP:
            number, tokens, self.next = self.next, 0, self.next + 1
        self.open[tier] = (number, tokens + tier)
        return number


def pack_partition(batches, tokenizer: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], base: int):
    """Record batches (doc_id, text) to record batches of SCHEMA. base: the first sequence_id and step group."""
    rows: list[tuple] = []
    groups, sequences = StepGroups(), 0

    def emit(pieces: list[Piece], tier: int) -> None:
        nonlocal sequences
        offset, group = 0, base + groups.group(tier)
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, base + sequences, offset, tier, group))
            offset += len(ids) // 4
        sequences += 1

    def flush():
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        rows.clear()
        return out

    packer = Packer(emit)
    end = np.array([END], "<u4").tobytes()
    for b in batches:
        flat, lengths = tokenizer(b.column(1))
        at = 0
        for doc_id, n in zip(b.column(0).to_pylist(), lengths.tolist(), strict=True):
            packer.add(doc_id, flat[at : at + n].tobytes() + end)
            at += n
            if len(rows) >= 4096:
                yield flush()
    packer.pack(True)
    if rows:
        yield flush()


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document, with its window (sequence_id) and place in it (offset).

    A document's ids are its tokens and the end id; a null text counts as empty and has the end id alone. Each id lies
    in exactly one piece. Partitions pack on their own, without a shuffle; sequence_id is unique over all of them and
    the same in every run over the same files. Null and repeated doc_ids are packed like any other row. An empty table
    gives no rows; further columns are ignored whatever their names.
    """
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(json.dumps(json.load(f)))

    def run(batches):
        from pyspark import TaskContext

        yield from pack_partition(batches, WordTokenizer.shared(spec.value), TaskContext.get().partitionId() << 40)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, SCHEMA)

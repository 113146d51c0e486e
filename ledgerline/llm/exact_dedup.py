"""Exact deduplication as a tree-merge of sorted digest runs.

Every partition sorts the digests of its documents into a run and merges equal ones. Partitions are numbered in base
``fan_in``. In round r, the runs whose numbers differ in digit r alone exchange their rows: the row goes to the run
whose digit r equals digit r of the digest, and each receiver merges up to ``fan_in`` sorted runs. After all rounds
a run owns a range of digests, and every digest has met all its equals. Each level keeps the smallest identifier and
the number of copies, so a text that a third of all rows share is one row per run before the first exchange.

Runs travel as blocks of sorted records. A receiver takes blocks in the order of their first digests: what lies below the
first digest of the block that came last is complete, is merged and leaves, so only blocks that overlap are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialise, ship, shuffle_partitions, text_or_empty, within, wrapped

BLOCKS = "node int, first binary, block binary"
MERGED = "digest binary, size_bytes long, check long, keep_id long, keep_row long, copies long"
#: A digest in four words; texts are equal where these and the next two agree. Of equals, the least of the three after stays.
WORDS, SAME, LEAST = ["d0", "d1", "d2", "d3"], ["size", "check"], ["no_id", "id", "row"]
RECORD = np.dtype([*((w, ">u8") for w in WORDS), ("size", "<i8"), ("check", "<i8"), ("no_id", "u1"), ("id", "<i8"), ("row", "<i8"), ("copies", "<i8")])
#: Records of a block.
BLOCK = 4096


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts, dtype=RECORD)  # left to itself it changes the order of bytes


def merged(records: np.ndarray) -> np.ndarray:
    """Records in order, equals made one: the least identifier and the sum of copies. Two different texts would have to
    agree in SHA-256, in length and in a second hash to be taken as equal."""
    if not len(records):
        return records
    records = records[np.lexsort([records[k] for k in reversed(WORDS + SAME + LEAST)])]
    new = np.ones(len(records), bool)
    new[1:] = np.any([records[k][1:] != records[k][:-1] for k in WORDS + SAME], axis=0)
    starts = np.flatnonzero(new)
    out = records[starts]
    out["copies"] = np.add.reduceat(records["copies"], starts)
    return out


def below(records: np.ndarray, digest: bytes) -> int:
    """How many of the records, in order, have a smaller digest."""
    low, high = 0, len(records)
    while low < high:
        middle = (low + high) // 2
        if records[middle : middle + 1].tobytes()[:32] < digest:
            low = middle + 1
        else:
            high = middle
    return low


def target(records: np.ndarray, width: int) -> np.ndarray:
    """The one of `width` equal ranges of digests that each record falls in, by the leading 32 bits."""
    return ((records["d0"] >> np.uint64(32)).astype(np.int64) * width) >> 32


class Senders:
    """Cuts a run of merged records into blocks for the runs with which it exchanges in a round."""

    def __init__(self, node: int, width: int, fan_in: int, level: int):
        self.node, self.width, self.fan_in, self.step = node, width, fan_in, fan_in**level
        self.held: list[list[np.ndarray]] = [[] for _ in range(fan_in)]

    def put(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        digit = target(records, self.width) // self.step % self.fan_in
        for d in np.unique(digit).tolist():
            self.held[d].append(records[digit == d])
            if sum(map(len, self.held[d])) >= BLOCK:
                yield from self.send(d)

    def send(self, d: int) -> Iterator[pa.RecordBatch]:
        run = joined(self.held[d])
        self.held[d] = []
        blocks = [run[i : i + BLOCK].tobytes() for i in range(0, len(run), BLOCK)]
        to = self.node + (d - self.node // self.step % self.fan_in) * self.step
        columns = [pa.array([to] * len(blocks), pa.int32()), pa.array([b[:32] for b in blocks], pa.binary()), pa.array(blocks, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "first", "block"])

    def close(self) -> Iterator[pa.RecordBatch]:
        for d in range(self.fan_in):
            if self.held[d]:
                yield from self.send(d)


def first_runs(batches, width: int, fan_in: int):
    """Rows (digest, size_bytes, check, doc_id, _row), sorted by digest, to blocks for the first round."""
    from pyspark import TaskContext

    out = Senders(TaskContext.get().partitionId() % width, width, fan_in, 0)
    held = np.empty(0, RECORD)
    for b in batches:
        if not b.num_rows:
            continue
        records = np.empty(b.num_rows, RECORD)
        words = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").reshape(-1, 4)
        for i, w in enumerate(WORDS):
            records[w] = words[:, i]
        records["size"], records["check"], records["row"] = (b.column(i).to_numpy() for i in (1, 2, 4))
        records["no_id"] = b.column(3).is_null().to_numpy(zero_copy_only=False)
        records["id"], records["copies"] = b.column(3).fill_null(0).to_numpy(), 1
        held = merged(joined([held, records]))
        done = below(held, held[-1:].tobytes()[:32])
        yield from out.put(held[:done])
        held = held[done:]
    yield from out.put(held)
    yield from out.close()


def merged_runs(batches) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (node, first, block), sorted by the first two, to (node, merged records in order)."""
    node, held = None, np.empty(0, RECORD)
    for b in batches:
        nodes, blocks = b.column(0).to_numpy(), [np.frombuffer(x, RECORD) for x in b.column(2).to_pylist()]
        starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]).tolist() if len(nodes) else []
        for s, e in zip(starts, [*starts[1:], len(nodes)], strict=True):
            if nodes[s] != node:
                if len(held):
                    yield node, held
                node, held = int(nodes[s]), np.empty(0, RECORD)
            held = merged(joined([held, *blocks[s:e]]))
            done = below(held, b.column(1)[e - 1].as_py())
            if done:
                yield node, held[:done]
                held = held[done:]
    if len(held):
        yield node, held


def exchange(batches, width: int, fan_in: int, level: int):
    """Merge what came in the round before and cut it for the round `level`."""
    out = None
    for node, records in merged_runs(batches):
        if out is None or out.node != node:
            if out:
                yield from out.close()
            out = Senders(node, width, fan_in, level)
        yield from out.put(records)
    if out:
        yield from out.close()


def opened(batches):
    """Merge what came in the last round, as rows of MERGED."""
    for _, r in merged_runs(batches):
        digest = np.stack([r[w] for w in WORDS], axis=1).astype(">u8").tobytes()
        columns = [pa.array([digest[i : i + 32] for i in range(0, len(digest), 32)], pa.binary()), pa.array(r["size"]), pa.array(r["check"])]
        columns += [pa.array(r["id"], mask=r["no_id"].astype(bool)), pa.array(r["row"]), pa.array(r["copies"])]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MERGED.split(", ")])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, _row, digest, size_bytes and check of the text with each run of white space made one space."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = F.regexp_replace(text_or_empty(text_col), SPACE, " ")
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("_row"), text.alias("_text"))
    return held.select(
        "doc_id", "_row", F.unhex(F.sha2(F.col("_text"), 256)).alias("digest"),
        F.octet_length("_text").cast("long").alias("size_bytes"), F.xxhash64("_text").alias("check"),
    )


def tree_merge(spark: SparkSession, rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row per distinct text: digest, size_bytes, check, keep_id, keep_row, copies."""
    levels = 1
    while fan_in**levels < shuffle_partitions(spark):
        levels += 1
    width = fan_in**levels
    run = rows.select("digest", "size_bytes", "check", "doc_id", "_row").sortWithinPartitions("digest").mapInArrow(lambda it: first_runs(it, width, fan_in), BLOCKS)
    for level in range(1, levels + 1):
        # A block goes to the very partition of its number; only blocks are sorted, not records.
        run = run.repartitionById(width, F.col("node")).sortWithinPartitions("node", "first")
        last = level == levels
        run = run.mapInArrow(opened, MERGED) if last else run.mapInArrow(lambda it, level=level: exchange(it, width, fan_in, level), BLOCKS)
    return run


def exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, _row, keep_id, group_size, kept, text_sha256.

    Equal texts are those identical after each run of ASCII white space is made one space; null counts as empty. Of
    equal texts the row with the smallest doc_id is kept; of rows that repeat that doc_id too, the first; a null doc_id
    comes after all others. An empty table gives an empty result. Other columns of docs are ignored, whatever their
    names. row_col names a column that numbers the rows, if there is one.
    """
    ship(spark)
    rows = materialise(spark, digests(docs, id_col, text_col, row_col), "digests")
    kept = materialise(spark, tree_merge(spark, rows, fan_in), "merged")
    same = ["digest", "size_bytes", "check"]
    return rows.join(kept, same).select(
        "doc_id", "_row", "keep_id", F.col("copies").alias("group_size"),
        (F.col("_row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates doesn't keep; all columns stay, whatever their names."""
    held = materialise(spark, wrapped(docs), "docs")
    found = exact_duplicates(spark, within(held, f"doc_id={id_col}", f"text={text_col}"), row_col="_row")
    return held.join(found.where(~F.col("kept")).select("_row"), "_row", "left_anti").select("_doc.*")

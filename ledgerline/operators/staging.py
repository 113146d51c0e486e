"""Intermediate tables in the shared folder: what is written there is computed once and outlives any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_dir(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests, local runs)."""
    sc = df.sparkSession.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        own = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Shuffle files of a statement go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: A table of more than LARGE bytes is dealt out in so many passes, each over its share of keys.
PASSES, LARGE = 4, 16 << 20


def staged(df: DataFrame, label: str) -> DataFrame:
    return staged_in_turn([df], label)


def staged_in_turn(parts: list[DataFrame], label: str) -> DataFrame:
    """All rows of parts of one schema. They are written one after the other, and shuffle files of one go before the next."""
    first = parts[0]
    path, conf = f"{shared_dir(first)}/{label}-{uuid.uuid4().hex}", first.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        for part in parts:
            part.select(*first.columns).write.mode("append").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return first.sparkSession.read.schema(first.schema).parquet(path)


def passes(df: DataFrame) -> int:
    """In how many passes to deal out a table, by the bytes that the optimizer expects of it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return PASSES if size > LARGE else 1


def share(df: DataFrame, i: int, n: int, *cols: str) -> DataFrame:
    """Rows of pass i of n: those of every n-th hash of whole numbers `cols`. Each row is in one pass, nulls too."""
    return df if n == 1 else df.where(F.pmod(F.xxhash64(*(F.col(c).cast("long") for c in cols)), F.lit(n)) == i)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df by cols over all shuffle partitions. What follows multiplies rows, so partitions must not be merged for having few
    bytes now; aggregates and windows by these columns need no other shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)

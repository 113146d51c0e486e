"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests, local runs) a temporary one is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        own = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialise(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    Unlike cached or local blocks, what is written outlives any executor.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Arrow batches to Python, the same for every operator: a lazy plan may run after another operator was called.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 20_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches in rows and bytes, so that whole texts may be long, and send this package to the executors once
    per context, so that Python workers can import it wherever they run."""
    for name, most in BATCH.items():
        spark.conf.set(name, str(most))
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="ledgerline-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "ledgerline_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "ledgerline").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(path)
    sc._ledgerline_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def wrapped(docs: DataFrame) -> DataFrame:
    """docs as one column _doc and a row number _row, so that no column of docs can clash with an operator's own."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    return docs.select(whole, F.monotonically_increasing_id().alias("_row"))


def within(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of wrapped documents, as doc_id, text and so on, beside _row."""
    return df.select("_row", *(F.col("_doc").getField(c).alias(a) for a, c in (n.split("=") for n in names)))

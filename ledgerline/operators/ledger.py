"""Ledger rows: occurrence numbers, fingerprints, idempotent import."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

IDENTITY = ["transaction_date", "amount", "direction", "description"]


def occurrences(rows: DataFrame) -> DataFrame:
    """Numbers, from 0, the rows of a file that are alike, in file order (file_id, line_no)."""
    order = Window.partitionBy("file_id", *IDENTITY).orderBy("line_no")
    return rows.withColumn("occurrence", F.row_number().over(order) - 1)


def fingerprints(rows: DataFrame) -> DataFrame:
    """SHA-256 of source, date, amount, direction, description and occurrence, joined by bars."""
    parts = [F.col("source_type").cast("string"), F.date_format("transaction_date", "yyyy-MM-dd"), F.col("amount").cast("string"), F.col("direction").cast("string"), F.coalesce("description", F.lit("")), F.col("occurrence").cast("string")]
    return rows.withColumn("row_fingerprint", F.sha2(F.concat_ws("|", *parts), 256))


def canonical(rows: DataFrame) -> DataFrame:
    """Parsed rows to transactions: occurrence, fingerprint, normalised name."""
    return fingerprints(occurrences(rows)).withColumn("normalized_name", normalize(F.coalesce("description", F.lit("")), bank=True))


def new_files(files: DataFrame, batches: DataFrame) -> DataFrame:
    """Files (client_id, file_sha256) that weren't imported before."""
    return files.join(batches.select("client_id", "file_sha256"), ["client_id", "file_sha256"], "left_anti")


def import_rows(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts of inserted and skipped rows by batch). A fingerprint is taken once for each client; in one
    import the smallest (batch_id, line_no) takes it."""
    order = Window.partitionBy("client_id", "row_fingerprint").orderBy("batch_id", "line_no")
    fresh = rows.withColumn("_rn", F.row_number().over(order)).join(existing.select("client_id", "row_fingerprint").distinct().withColumn("_known", F.lit(True)), ["client_id", "row_fingerprint"], "left")
    marked = fresh.withColumn("_new", (F.col("_rn") == 1) & F.col("_known").isNull())
    counts = marked.groupBy("batch_id").agg(F.count_if("_new").alias("inserted"), F.count_if(~F.col("_new")).alias("skipped"))
    return marked.where("_new").select(*rows.columns), counts

"""The hash-chained audit trail: payloads, appending, verification, pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
#: Columns of the payload after the previous hash, in order.
PAYLOAD = ["organization_id", "actor_id", "target_table", "target_id", "action", "before", "after", "threshold_id", "occurred_at"]


def body() -> Column:
    """The payload of a row without the previous hash. before and after are canonical JSON strings; times are in UTC."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    at = F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat_ws(SEPARATOR, *(text(c) for c in PAYLOAD[:-1]), F.coalesce(at, F.lit("")))


def payload(prev: Column) -> Column:
    return F.concat(F.coalesce(prev, F.lit("")), F.lit(SEPARATOR), body())


def row_hash(prev: Column) -> Column:
    return F.sha2(payload(prev), 256)


def chain(rows: DataFrame, last_hash: str | None = None) -> DataFrame:
    """rows with prev_hash and row_hash, chained in order of id after last_hash.

    A hash needs the one before, so the fold is sequential by nature; only ids and payloads go through it, as a stream in
    one task, and the rows meet their hashes again by id.
    """
    ordered = rows.select("id", body().alias("body")).repartition(1).sortWithinPartitions("id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = last_hash
        for b in batches:
            before, after = [], []
            for text in b["body"]:
                before.append(prev)
                prev = hashlib.sha256(f"{prev or ''}{SEPARATOR}{text}".encode()).hexdigest()
                after.append(prev)
            yield pd.DataFrame({"id": b["id"], "prev_hash": pd.array(before, "object"), "row_hash": after})

    return rows.join(ordered.mapInPandas(fold, "id long, prev_hash string, row_hash string"), "id").withColumn("hash_version", F.lit(2))


def entries(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows of PAYLOAD columns with the ids that follow the log's, in order of target. As many as people's orders are, so
    one task numbers them; chain() folds them one by one anyway."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
    order = Window.orderBy("target_table", "target_id", "action")
    return rows.select(*PAYLOAD).withColumn("id", F.lit(last) + F.row_number().over(order))


def last_hash(log: DataFrame) -> DataFrame:
    return log.agg(F.max_by("row_hash", "id").alias("row_hash"))


def with_previous(log: DataFrame, span: int = 1_000_000) -> DataFrame:
    """log with expect_prev, the row_hash of the row before by id, and is_first.

    Rows are dealt by id range, each range takes its own lag, and its first row the last hash of the nearest range before
    that has rows; so no task sees the whole log.
    """
    own = log.withColumn("_span", F.floor(F.col("id") / span))
    order = Window.partitionBy("_span").orderBy("id")
    own = own.withColumns({"_lag": F.lag("row_hash").over(order), "_rn": F.row_number().over(order)})
    last = own.groupBy("_span").agg(F.max_by("row_hash", "id").alias("_last"))
    # One row for each span that has rows.
    edges = last.select("_span", F.lag("_last").over(Window.orderBy("_span")).alias("_edge"), (F.row_number().over(Window.orderBy("_span")) == 1).alias("_least"))
    out = own.join(edges, "_span")
    first = F.col("_rn") == 1
    return out.withColumns({"expect_prev": F.when(first, F.col("_edge")).otherwise(F.col("_lag")), "is_first": first & F.col("_least")}).drop("_span", "_lag", "_rn", "_edge", "_least")


def scope(log: DataFrame, from_id: int | None = None, to_id: int | None = None) -> DataFrame:
    """Rows of a range and the one before it, whose hash the first row is held against."""
    if from_id is not None:
        before = log.where(F.col("id") < from_id).agg(F.max("id")).first()[0]
        log = log.where(F.col("id") >= (from_id if before is None else before))
    return log if to_id is None else log.where(F.col("id") <= to_id)


def verify(log: DataFrame, from_id: int | None = None, to_id: int | None = None) -> DataFrame:
    """(bad_id, reason): rows whose link or content doesn't fit. The first row's link can't be told; missing rows at the
    head or the tail can't be noticed."""
    rows = with_previous(scope(log, from_id, to_id))
    link = ~F.col("is_first") & ~F.col("prev_hash").eqNullSafe(F.col("expect_prev"))
    content = (F.col("hash_version") == 2) & ~F.col("row_hash").eqNullSafe(row_hash(F.col("prev_hash")))
    return rows.where(link | content).select(F.col("id").alias("bad_id"), F.when(link, F.lit("link broken")).otherwise(F.lit("content does not match hash")).alias("reason"))


def page(log: DataFrame, cursor: int | None = None, size: int = 50, **filters) -> DataFrame:
    """The `size` rows before cursor, newest first, and one more row if there are more (has_more is true on each row then).

    filters: action, actor_id, target_table, target_id, since and until (dates, both included).
    """
    for c in ("action", "actor_id", "target_table", "target_id"):
        if filters.get(c) is not None:
            log = log.where(F.col(c) == filters[c])
    if filters.get("since") is not None:
        log = log.where(F.col("occurred_at") >= F.to_timestamp(F.lit(filters["since"])))
    if filters.get("until") is not None:
        log = log.where(F.col("occurred_at") < F.to_timestamp(F.lit(filters["until"])) + F.expr("INTERVAL 1 DAY"))
    if cursor is not None:
        log = log.where(F.col("id") < cursor)
    rows = log.orderBy(F.col("id").desc()).limit(size + 1)
    numbered = rows.withColumns({"_rn": F.row_number().over(Window.orderBy(F.col("id").desc())), "has_more": F.count("*").over(Window.partitionBy()) > size})
    return numbered.where(F.col("_rn") <= size).drop("_rn")


def summary() -> Column:
    """A line for a row of the trail, by action."""
    old, new = F.get_json_object("before", "$.partner"), F.get_json_object("after", "$.partner")
    names = {"auto_approve": "approved automatically", "approve": "approved", "reject": "rejected", "needs_review": "sent to review", "forget_alias": "alias forgotten"}
    out = F.col("action")
    for k, v in names.items():
        out = F.when(F.col("action") == k, F.lit(v)).otherwise(out)
    return F.when(F.col("action") == "correct", F.concat(F.lit("corrected: "), F.coalesce(old, F.lit("none")), F.lit(" to "), F.coalesce(new, F.lit("none")))).otherwise(out)


def actions(log: DataFrame) -> DataFrame:
    return log.select("action").distinct().orderBy("action")

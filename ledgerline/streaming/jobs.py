"""Streaming forms of the stateful operators; each gives what its batch form gives over the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import audit
from ..operators.mutations import upsert


def first_events(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event_id once: for ever, or only within `delay` of its received_at, which bounds the state but lets an event
    that comes again later through."""
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["event_id"])


GRACE = pd.Timedelta(days=14)
#: How long after an event the same id is known as a repeat.
REMEMBERED = pd.Timedelta(days=90)


def next_state(status: str | None, grace, event) -> tuple[str, object]:
    """A subscription's state after an event: canceled stays, grace begins once, a success ends it."""
    failed, paid = bool(event.payment_failed), bool(event.payment_succeeded)
    said = event.status if isinstance(event.status, str) and event.status else None
    if said is None:
        said = status or "active"
        if failed and said in ("active", "trialing"):
            said = "past_due"
        elif paid and said in ("past_due", "unpaid"):
            said = "active"
    if paid or event.status == "active":
        grace = None
    elif failed and grace is None:
        grace = event.received_at + GRACE
    return ("canceled" if status == "canceled" else said), grace


def _fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, status, grace_us, seen = state.get if state.exists else (0, None, None, "")
    grace = None if grace_us is None else pd.Timestamp(grace_us, unit="us")
    known = {i: int(at) for i, at in (x.rsplit("\x1e", 1) for x in seen.split("\x1f"))} if seen else {}
    rows = pd.concat(list(batches)).sort_values(["received_at", "event_id"])
    for e in rows.itertuples():
        if e.event_id in known:
            continue
        known[e.event_id] = int(e.received_at.value // 1000)
        status, grace = next_state(status, grace, e)
        n += 1
    least = max(known.values(), default=0) - int(REMEMBERED.value // 1000)
    seen = "\x1f".join(f"{i}\x1e{at}" for i, at in sorted(known.items()) if at >= least)
    state.update((n, status, None if grace is None else int(grace.value // 1000), seen))
    yield pd.DataFrame({"subscription_id": [key[0]], "n_events": [n], "status": [status], "grace_until": pd.Series([grace], dtype="datetime64[ns]")})


def subscription_states(events: DataFrame) -> DataFrame:
    """The state of each subscription after every micro-batch that touches it. Ids of events are remembered with the state,
    so recording an event and applying it are one step; ids older than REMEMBERED before the newest are forgotten, which
    bounds the state. An id belongs to one subscription, so each remembers its own."""
    return events.groupBy("subscription_id").applyInPandasWithState(
        _fold, "subscription_id string, n_events long, status string, grace_until timestamp", "n long, status string, grace_us long, seen string", "update", GroupStateTimeout.NoTimeout
    )


JOB_STATES = {"claim": "running", "done": "done", "fail": "waiting"}


def _queue(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts = state.get if state.exists else ("waiting", 0)
    for e in pd.concat(list(batches)).sort_values("event_id").itertuples():
        if status in ("done", "failed"):
            continue
        if e.kind == "claim" and status == "waiting":
            status, attempts = "running", attempts + 1
        elif e.kind == "done" and status == "running":
            status = "done"
        elif e.kind in ("fail", "expire") and status == "running":
            status = "failed" if attempts >= 3 else "waiting"
    state.update((status, attempts))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})


def queue_states(events: DataFrame) -> DataFrame:
    """(job_id, event_id, kind: claim, done, fail, expire) to each job's state; three attempts at most."""
    return events.groupBy("job_id").applyInPandasWithState(_queue, "job_id long, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.NoTimeout)


def append_chained(read_log: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: chains each micro-batch to the log's last row. One query writes the log, so the chain can't fork;
    rows whose id the log has already (a batch that runs again) are left out."""

    def run(batch: DataFrame, _: int) -> None:
        log = read_log()
        last = audit.last_hash(log).first()
        fresh = batch.join(log.select("id"), "id", "left_anti")
        write(audit.chain(fresh, last["row_hash"] if last else None))

    return run


def upserting(read_old: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch replaces rows with its keys."""
    return lambda batch, _: write(upsert(read_old(), batch, keys))


def settle_arrivals(settle_clients: Callable[[DataFrame], None], key: str = "client_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch over new documents or transactions: settles the clients that a micro-batch touches."""
    return lambda batch, _: settle_clients(batch.select(key).distinct())


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Everything there is now, into Parquet under path: a folder for each micro-batch, written over if it runs again."""
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_rows(spark: SparkSession, path: str, schema: StructType, keys: list[str] | None) -> DataFrame:
    """What a table of micro-batches holds: of each key the row of the last batch; all rows where keys is None, and the rows
    of the last batch alone where it is empty."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    if keys is None:
        return rows.drop("batch")
    if not keys:
        return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in schema.names if c not in keys)), "batch").alias("v"))
    return last.select(*keys, "v.*").select(*schema.names)


def windowed_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """An extension: counts and sums of events by time window and type, late rows kept for `delay`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

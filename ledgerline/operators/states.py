"""State machines over ordered events: subscriptions and the work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import backoff_seconds
from .mutations import apply_subscription_event

STATE = "struct<status:string,grace_until:timestamp>"


def fold_subscriptions(events: DataFrame) -> DataFrame:
    """events (event_id, subscription_id, status, payment_failed, payment_succeeded, received_at) to each subscription's
    state. An event id counts once, at its first arrival; events apply in order of arrival, whatever their own times."""
    once = events.groupBy("event_id").agg(F.min_by(F.struct("subscription_id", "status", "payment_failed", "payment_succeeded", "received_at"), "received_at").alias("e")).select("event_id", "e.*")
    ordered = once.groupBy("subscription_id").agg(F.array_sort(F.collect_list(F.struct("received_at", "event_id", "status", "payment_failed", "payment_succeeded"))).alias("events"))

    def step(acc: Column, e: Column) -> Column:
        new = apply_subscription_event({k: e[k] for k in ("status", "payment_failed", "payment_succeeded")}, {"status": acc["status"], "grace_until": acc["grace_until"]}, e["received_at"])
        return F.struct(*(v.alias(k) for k, v in new.items()))

    start = F.lit(None).cast(STATE)
    start = F.struct(start["status"].alias("status"), start["grace_until"].alias("grace_until"))
    return ordered.select("subscription_id", F.size("events").alias("n_events"), F.aggregate("events", start, step).alias("s")).select("subscription_id", "n_events", "s.status", "s.grace_until")


def claimable(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Jobs that may start: due, and waiting or with an expired lease and attempts left; the earliest first."""
    free = (F.col("status") == 1) | ((F.col("status") == 2) & (F.col("locked_until") < now) & (F.col("attempts") < F.col("max_attempts")))
    return jobs.where((F.col("run_after") <= now) & free).orderBy("run_after", "job_id").limit(limit)


def claim(jobs: DataFrame, now: Column, worker: str, limit: int, lease_seconds: int = 30) -> DataFrame:
    """jobs after a worker took up to `limit` of them."""
    taken = claimable(jobs, now, limit).select("job_id", F.lit(True).alias("_taken"))
    out = jobs.join(taken, "job_id", "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))
    return out.withColumns({
        "status": F.when(F.col("_taken"), 2).otherwise(F.col("status")), "attempts": F.col("attempts") + F.col("_taken").cast("int"), "locked_by": F.when(F.col("_taken"), F.lit(worker)).otherwise(F.col("locked_by")),
        "locked_until": F.when(F.col("_taken"), now + F.expr(f"INTERVAL {lease_seconds} SECONDS")).otherwise(F.col("locked_until")),
    }).drop("_taken")


def touch(jobs: DataFrame, worker: str, now: Column, lease_seconds: int = 30) -> DataFrame:
    """A heartbeat: leases that the worker still holds begin anew."""
    mine = (F.col("status") == 2) & (F.col("locked_by") == worker)
    return jobs.withColumn("locked_until", F.when(mine, now + F.expr(f"INTERVAL {lease_seconds} SECONDS")).otherwise(F.col("locked_until")))


def finish(jobs: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """jobs after reports (job_id, worker, ok, error). Only the worker that holds a job may report on it; a failed job
    waits attempts squared times ten seconds, or fails for good when its attempts are used up."""
    out = jobs.join(reports.select("job_id", F.col("worker").alias("_w"), F.col("ok").alias("_ok"), F.col("error").alias("_e")), "job_id", "left")
    mine = F.coalesce((F.col("status") == 2) & (F.col("locked_by") == F.col("_w")), F.lit(False))
    again = F.col("attempts") < F.col("max_attempts")
    status = F.when(F.col("_ok"), 3).when(again, 1).otherwise(4)
    wait = F.timestamp_seconds(F.unix_timestamp(now) + backoff_seconds(F.col("attempts")))
    return out.withColumns({
        "run_after": F.when(mine & ~F.col("_ok") & again, wait).otherwise(F.col("run_after")), "status": F.when(mine, status).otherwise(F.col("status")),
        "last_error": F.when(mine & ~F.col("_ok"), F.col("_e")).otherwise(F.col("last_error")), "locked_by": F.when(~mine, F.col("locked_by")),
    }).drop("_w", "_ok", "_e")


def replayable(requests: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Requests whose time lies within the window around now."""
    return requests.where(F.abs(F.unix_timestamp("sent_at") - F.unix_timestamp(now)) <= 60 * minutes)

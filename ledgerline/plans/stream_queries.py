"""Stateful operators: batch folds and the same as streams that run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import states
from ..operators.staging import shared_dir
from ..streaming import jobs
from .model import model
from .registry import query


def events(spark: SparkSession, d: str) -> DataFrame:
    return subscription_events(model(spark, d, "events"))


def subscription_events(e: DataFrame) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 6 == 0, "active").when(k % 6 == 1, "past_due").when(k % 97 == 2, "canceled").otherwise("")
    return e.select((F.floor(k / 2) * 2 + F.when(k % 10 == 1, 0).otherwise(k % 2)).cast("string").alias("event_id"), F.concat(F.lit("sub_"), (F.col("user_id") % 20).cast("string")).alias("subscription_id"), status.alias("status"), (k % 6 == 2).alias("payment_failed"), (k % 6 == 3).alias("payment_succeeded"), F.col("ts").cast("timestamp").alias("received_at"))


#: The fold, event by event: canceled stays, a grace period begins once and ends with a success. {0}: what repeats an event.
FOLD = """WITH RECURSIVE e AS (
  SELECT CAST(event_id // 2 * 2 + CASE WHEN event_id % 10 = 1 THEN 0 ELSE event_id % 2 END AS VARCHAR) AS event_id, 'sub_' || CAST(user_id % 20 AS VARCHAR) AS subscription_id,
    CASE WHEN event_id % 6 = 0 THEN 'active' WHEN event_id % 6 = 1 THEN 'past_due' WHEN event_id % 97 = 2 THEN 'canceled' ELSE '' END AS said, event_id % 6 = 2 AS failed, event_id % 6 = 3 AS paid, CAST(ts AS TIMESTAMP) AS came FROM {events}
), o AS (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY came, event_id) AS n FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY ONCE ORDER BY came) = 1)
), f(subscription_id, n, status, grace_until) AS (
  SELECT DISTINCT subscription_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP) FROM o
  UNION ALL
  SELECT f.subscription_id, o.n, CASE WHEN f.status = 'canceled' THEN 'canceled' WHEN said <> '' THEN said WHEN failed AND coalesce(f.status, 'active') IN ('active', 'trialing') THEN 'past_due' WHEN paid AND f.status IN ('past_due', 'unpaid') THEN 'active' ELSE coalesce(f.status, 'active') END,
    CASE WHEN paid OR said = 'active' THEN NULL WHEN failed THEN coalesce(f.grace_until, came + INTERVAL 14 DAYS) ELSE f.grace_until END
  FROM f JOIN o ON o.subscription_id = f.subscription_id AND o.n = f.n + 1
) SELECT subscription_id, CAST(n AS TYPE) AS n_events, status, grace_until FROM f QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY n DESC) = 1"""


@query(FOLD.replace("ONCE", "event_id").replace("TYPE", "INTEGER"))
def billing_event_fold(spark, d):
    return states.fold_subscriptions(events(spark, d)).withColumn("grace_until", F.col("grace_until").cast("timestamp_ntz"))


@query("SELECT count(DISTINCT CAST(event_id // 2 * 2 + CASE WHEN event_id % 10 = 1 THEN 0 ELSE event_id % 2 END AS VARCHAR)) AS n FROM {events}")
def event_dedupe(spark, d):
    return jobs.first_events(events(spark, d)).agg(F.count("*").alias("n"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = model(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _finish(stream: DataFrame, name: str, mode: str, keys: list[str] | None) -> DataFrame:
    spark = stream.sparkSession
    folder = f"{shared_dir(stream)}/{name}-{uuid.uuid4().hex}"
    jobs.run_to_table(stream, f"{folder}/table", f"{folder}/checkpoint", mode)
    return jobs.latest_rows(spark, f"{folder}/table", stream.schema, keys)


@query("SELECT count(DISTINCT CAST(event_id // 2 * 2 + CASE WHEN event_id % 10 = 1 THEN 0 ELSE event_id % 2 END AS VARCHAR)) AS n FROM {events}")
def stream_event_dedupe(spark, d):
    return _finish(jobs.first_events(subscription_events(_stream(spark, d))), "stream_event_dedupe", "append", None).agg(F.count("*").alias("n"))


@query(FOLD.replace("ONCE", "event_id, subscription_id").replace("TYPE", "BIGINT"))
def stream_subscriptions(spark, d):
    found = _finish(jobs.subscription_states(subscription_events(_stream(spark, d))), "stream_subscriptions", "update", ["subscription_id"])
    return found.withColumn("grace_until", F.col("grace_until").cast("timestamp_ntz"))


@query("""WITH RECURSIVE o AS (SELECT user_id % 50 AS job_id, CASE WHEN event_id % 3 = 0 THEN 'claim' WHEN event_id % 7 = 1 THEN 'done' ELSE 'fail' END AS kind, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM {events}
), f(job_id, n, status, attempts) AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT), 'waiting', 0 FROM o
  UNION ALL
  SELECT f.job_id, o.n, CASE WHEN status = 'waiting' AND kind = 'claim' THEN 'running' WHEN status = 'running' AND kind = 'done' THEN 'done' WHEN status = 'running' AND kind = 'fail' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'waiting' END ELSE status END,
    CASE WHEN status = 'waiting' AND kind = 'claim' THEN attempts + 1 ELSE attempts END
  FROM f JOIN o ON o.job_id = f.job_id AND o.n = f.n + 1
) SELECT CAST(job_id AS BIGINT) AS job_id, status, CAST(attempts AS INTEGER) AS attempts FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1""")
def stream_queue_fold(spark, d):
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "claim").when(k % 7 == 1, "done").otherwise("fail")
    return _finish(jobs.queue_states(_stream(spark, d).select((F.col("user_id") % 50).cast("long").alias("job_id"), "event_id", kind.alias("kind"))), "stream_queue_fold", "update", ["job_id"])


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM {events} GROUP BY ALL")
def stream_windowed_counts(spark, d):
    out = _finish(jobs.windowed_counts(_stream(spark, d)), "stream_windowed_counts", "complete", [])
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n")

"""Streams that run to their end give what the batch forms give."""

import datetime

from pyspark.sql import functions as F

from ledgerline.operators import audit, states
from ledgerline.plans import stream_queries
from ledgerline.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_subscription_stream_equals_batch(spark):
    got = {r.subscription_id: (r.n_events, r.status, r.grace_until) for r in stream_queries.stream_subscriptions(spark, SF).collect()}
    # A stream's state knows the events of one subscription; repeats across subscriptions don't occur in a real feed.
    events = stream_queries.events(spark, SF).withColumn("event_id", F.concat("event_id", F.lit("/"), "subscription_id"))
    want = {r.subscription_id: (r.n_events, r.status, r.grace_until) for r in states.fold_subscriptions(events).collect()}
    assert got == want


def test_chain_by_micro_batches(spark, tmp_path):
    rows = [(i, 1, None, "t", i, "a", None, "{}", None, datetime.datetime(2026, 1, 1)) for i in range(1, 41)]
    schema = "id long, organization_id long, actor_id long, target_table string, target_id long, action string, before string, after string, threshold_id long, occurred_at timestamp"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "log")
    audit.chain(df.where("id <= 10")).write.parquet(path)
    append = jobs.append_chained(lambda: spark.read.parquet(path), lambda new: new.write.mode("append").parquet(path))
    append(df.where("id > 10 AND id <= 30"), 0)
    append(df.where("id > 10 AND id <= 30"), 0)
    append(df.where("id > 30"), 1)
    log = spark.read.parquet(path)
    assert log.count() == 40 and audit.verify(log).count() == 0


def test_upserts_by_micro_batches(spark):
    kept = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")}
    run = jobs.upserting(lambda: kept["t"], lambda df: kept.update(t=df), ["k"])
    run(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), 0)
    assert sorted(map(tuple, kept["t"].collect())) == [(1, "a"), (2, "c"), (3, "d")]
    seen = []
    jobs.settle_arrivals(lambda clients: seen.extend(r.k for r in clients.collect()), "k")(kept["t"], 0)
    assert sorted(seen) == [1, 2, 3]

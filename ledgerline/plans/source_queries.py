"""Sources: statements, masters, blocks, files, lookups, webhooks. What is read is written out from the driver's tables first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from .model import model
from .registry import query

#: One statement for each user: a date in four notations, blanks of several kinds about amounts, lines without money.
LINES = """SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS line_no, CAST(ts AS DATE) AS day, event_type, CAST(floor(value) AS BIGINT) % 90000 + 1 AS amount,
  user_id % 10 = 9 AND event_id % 5 = 0 AS undated FROM {events}"""


def _money(n: Column) -> Column:
    return F.concat(F.lit('"'), F.when(n > 999, F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string")), F.lit('"'))


def _day(day: Column, k: Column) -> Column:
    return F.when(k % 4 == 0, F.date_format(day, "yyyy/MM/dd")).when(k % 4 == 1, F.date_format(day, "yyyy-M-d")).when(k % 4 == 2, F.date_format(day, "yyyy年M月d日")).otherwise(F.concat(F.lit("　"), F.date_format(day, "yyyyMMdd"), F.lit("\t")))


def _files(lines: DataFrame, header: str, cells: list[Column]) -> DataFrame:
    text = lines.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("line_no", F.concat_ws(",", *cells).alias("t")))).alias("l"))
    whole = F.concat(F.when(F.col("user_id") % 2 == 0, "﻿").otherwise(""), F.lit(header + "\n"), F.array_join(F.transform("l", lambda x: x.t), "\n"))
    return text.select(F.col("user_id").cast("string").alias("path"), F.encode(whole, "UTF-8").alias("content"))


def bank_files(spark: SparkSession, d: str) -> DataFrame:
    lines, k, n = spark.sql(LINES, events=model(spark, d, "events")), F.col("event_id"), F.col("amount")
    out = F.when(k % 3 == 0, _money(n)).when(k % 3 == 2, F.lit("　")).otherwise(F.lit(""))
    into = F.when(k % 3 == 1, F.concat(_money(n))).otherwise(F.lit("0"))
    return _files(lines, "取引日,お取引内容,出金額,入金額", [F.when(F.col("undated"), F.lit("soon")).otherwise(_day(F.col("day"), k)), F.concat(F.lit('" '), F.col("event_type"), F.lit('\t"')), out, into])


def card_files(spark: SparkSession, d: str) -> DataFrame:
    lines, k, n = spark.sql(LINES, events=model(spark, d, "events")), F.col("event_id"), F.col("amount").cast("string")
    amount = F.when(k % 5 == 0, F.concat(F.lit("　▲"), n)).when(k % 5 == 1, F.concat(F.lit("\t-"), n)).when(k % 5 == 2, F.lit("0")).when(k % 5 == 3, F.translate(n, "0123456789", "０１２３４５６７８９")).otherwise(F.concat(F.lit("¥"), n))
    return _files(lines.withColumn("undated", F.lit(False)), "利用日,ご利用先,利用金額", [_day(F.col("day"), k), F.col("event_type"), amount])


@query(f"SELECT CAST(user_id AS VARCHAR) AS path, line_no, day AS transaction_date, amount, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS direction, event_type AS description FROM ({LINES}) WHERE event_id % 3 < 2 AND user_id NOT IN (SELECT user_id FROM ({LINES}) WHERE undated AND event_id % 3 < 2)")
def read_bank_statements(spark, d):
    lines = readers.csv_lines(bank_files(spark, d))
    rows = readers.bank_rows(lines)
    bad = readers.check_files(lines, rows)
    return rows.join(bad.select("path"), "path", "left_anti").select("path", "line_no", "transaction_date", "amount", "direction", "description")


@query(f"SELECT CAST(user_id AS VARCHAR) AS path, 'line ' || CAST(min(line_no) + 1 AS VARCHAR) || ': no date in ''soon''' AS error FROM ({LINES}) WHERE undated AND event_id % 3 < 2 GROUP BY user_id UNION ALL SELECT CAST(user_id AS VARCHAR), 'no usable row' FROM ({LINES}) GROUP BY user_id HAVING count(*) FILTER (event_id % 3 < 2) = 0")
def reject_statements(spark, d):
    lines = readers.csv_lines(bank_files(spark, d))
    return readers.check_files(lines, readers.bank_rows(lines))


@query(f"SELECT CAST(user_id AS VARCHAR) AS path, line_no, day AS transaction_date, amount, CASE WHEN event_id % 5 < 2 THEN 1 ELSE 2 END AS direction, event_type AS description FROM ({LINES}) WHERE event_id % 5 <> 2")
def read_card_statements(spark, d):
    rows = readers.card_rows(readers.csv_lines(card_files(spark, d)))
    return rows.select("path", "line_no", "transaction_date", "amount", "direction", "description")


@query(f"SELECT CAST(user_id AS VARCHAR) AS path, CASE user_id % 4 WHEN 0 THEN 'empty file' WHEN 1 THEN 'not readable as CSV: a quote within a cell, or one that isn''t closed' WHEN 2 THEN 'not readable as CSV: a quote within a cell, or one that isn''t closed' ELSE 'no usable row' END AS error FROM (SELECT DISTINCT user_id FROM {{events}})")
def malformed_statements(spark, d):
    users = model(spark, d, "events").select("user_id").distinct()
    text = F.when(F.col("user_id") % 4 == 0, "").when(F.col("user_id") % 4 == 1, '日付,摘要\n2026/01/02,"open').when(F.col("user_id") % 4 == 2, '日付,摘要\n2026/01/02,a "b" c').otherwise("日付,摘要\n")
    lines = readers.csv_lines(users.select(F.col("user_id").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content")))
    return readers.check_files(lines, readers.bank_rows(lines))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS BIGINT) + 5000000 ELSE CAST(row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS BIGINT) END AS id, p_name AS canonical, 'a' || p_brand AS alias FROM {part}""")
def read_masters_json(spark, d):
    """Forty files of masters, two thirds without an id; of each its aliases."""
    m = F.struct(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 5_000_000).alias("id"), F.col("p_name").alias("canonical"), F.array("p_name", F.concat(F.lit("a"), "p_brand")).alias("variants"))
    files = model(spark, d, "part").groupBy((F.col("p_partkey") % 40).alias("file")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", m.alias("m")))).alias("l"))
    masters = readers.parse_masters(files.select(F.to_json(F.transform("l", lambda x: x.m)).alias("value")))
    return masters.select("id", "canonical", F.explode("variants").alias("alias")).where("alias != canonical")


@query("SELECT CAST(s_suppkey AS BIGINT) AS document_id, CAST(i AS INTEGER) AS seq, s_name || CAST(i AS VARCHAR) AS text, CAST(10 * i AS INTEGER) AS x FROM {supplier}, (SELECT unnest([0, 1, 2]) AS i)")
def read_blocks_json(spark, d):
    blocks = F.transform(F.array(*(F.lit(i) for i in range(3))), lambda i: F.struct(F.concat("s_name", i.cast("string")).alias("text"), (i * 10).alias("x")))
    bodies = model(spark, d, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("document_id"), blocks.alias("blocks"))).alias("value"))
    parsed = bodies.select(F.from_json("value", readers.BLOCKS).alias("v")).select("v.*")
    return readers.explode_blocks(parsed).select("document_id", "seq", "text", "x")


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'invalid' WHEN 2 THEN 'image' WHEN 3 THEN 'image' ELSE 'other' END AS kind FROM {part}")
def document_kinds(spark, d):
    k = F.col("p_partkey") % 5
    path = F.concat(F.lit("/in/"), "p_name", F.element_at(F.array(*(F.lit(x) for x in (".PDF", ".pdf", ".jpeg", ".PNG", ".txt"))), (k + 1).cast("int")))
    files = model(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), path.alias("path"), F.when(k == 0, F.lit(b"%PDF-1.7")).otherwise(F.lit(b"plain")).alias("content"))
    return files.select("id", readers.document_kind(F.col("path"), F.col("content")).alias("kind"))


NUMBERS = "SELECT DISTINCT client_id, reg_no FROM {reg_checks} JOIN {docs} USING (document_id) WHERE reg_no IS NOT NULL"
BATCHED = f"SELECT *, (row_number() OVER (PARTITION BY client_id ORDER BY reg_no) - 1) // 10 AS batch FROM ({NUMBERS})"


@query(f"SELECT client_id, reg_no, (client_id + batch) % 3 <> 0 AS answered, CASE WHEN (client_id + batch) % 3 <> 0 THEN reg_no NOT LIKE '%5' END AS found, CASE WHEN (client_id + batch) % 3 <> 0 AND reg_no NOT LIKE '%5' AND reg_no LIKE '%7' THEN '2024-03-31' END AS revoked_on FROM ({BATCHED})")
def lookup_partial_failure(spark, d):
    """One batch of ten in three fails: no answer, or one that can't be read."""
    numbers = model(spark, d, "reg_checks").where("reg_no IS NOT NULL").join(model(spark, d, "docs").select("document_id", "client_id"), "document_id")
    batches = readers.lookup_batches(numbers)
    known = F.struct(F.substring("reg_no", 2, 13).alias("registratedNumber"), F.lit("x").alias("name"), F.lit("").alias("address"), F.when(F.col("reg_no").endswith("7"), "2024-03-31").otherwise("").alias("disposalDate"))
    body = batches.groupBy("client_id", "batch").agg(F.collect_list(F.when(~F.col("reg_no").endswith("5"), known)).alias("announcement"))
    fails = (F.col("client_id") + F.col("batch")) % 3 == 0
    answers = body.select("client_id", "batch", F.when(fails & (F.col("batch") % 2 == 0), 503).otherwise(200).alias("status"), F.when(fails, "<html>").otherwise(F.to_json(F.struct("announcement"))).alias("body"))
    return readers.lookup_answers(batches, answers).select("client_id", "reg_no", "answered", "found", "revoked_on")


KINDS = ("customer.subscription.created", "customer.subscription.deleted", "invoice.payment_failed", "invoice.payment_succeeded", "charge.refunded")


@query("SELECT 'evt_' || CAST(event_id AS VARCHAR) AS event_id, 'sub_' || CAST(user_id AS VARCHAR) AS subscription_id, CASE event_id % 5 WHEN 0 THEN 'trialing' WHEN 1 THEN 'canceled' END AS status, event_id % 5 = 2 AS payment_failed, event_id % 5 = 3 AS payment_succeeded FROM {events} WHERE event_id % 5 < 4")
def webhook_rows(spark, d):
    k, sub = F.col("event_id") % 5, F.concat(F.lit("sub_"), F.col("user_id").cast("string"))
    own = F.struct(F.when(k < 2, sub).otherwise("in_1").alias("id"), F.when(k >= 2, sub).alias("subscription"), F.when(k < 2, "trialing").otherwise("paid").alias("status"))
    body = F.struct(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, KINDS)), (k + 1).cast("int")).alias("type"), F.struct(own.alias("object")).alias("data"))
    bodies = model(spark, d, "events").select(F.to_json(body).alias("body"), F.col("ts").cast("timestamp").alias("received_at"))
    return readers.webhook_events(bodies).select("event_id", "subscription_id", "status", "payment_failed", "payment_succeeded")


SECRET = "not a real secret"
_PAD = SECRET.encode().ljust(64, b"\0")
_INNER, _OUTER = (bytes(k ^ x for k in _PAD).hex() for x in (0x36, 0x5C))
_MESSAGE = "'v1' || chr(10) || 'POST' || chr(10) || '/documents' || chr(10) || '' || chr(10) || CAST(event_id AS VARCHAR) || chr(10) || CAST(user_id AS VARCHAR) || chr(10) || sha256(coalesce(props, ''))"


@query(f"SELECT event_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({_MESSAGE})))) AS signature FROM {{events}} WHERE event_id % 3 <> 0")
def signed_requests(spark, d):
    """Requests of which one in three has its body changed after signing."""
    e = model(spark, d, "events").select("event_id", F.lit("POST").alias("method"), F.lit("/documents").alias("path"), F.lit("").alias("query"), F.col("event_id").alias("sent_at"), F.col("user_id").alias("organization_id"), F.coalesce(F.col("props").cast("string"), F.lit("")).alias("body"))
    parts = [F.lit("v1"), *(F.col(c) for c in ("method", "path", "query", "sent_at", "organization_id"))]
    sent = e.withColumn("signature", F.concat(F.lit("v1="), readers.signature(SECRET, parts, F.col("body"))))
    sent = sent.withColumn("body", F.when(F.col("event_id") % 3 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return readers.signed(sent, SECRET).select("event_id", F.substring("signature", 4, 64).alias("signature"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, sha256(c_name || chr(10) || c_mktsegment) AS file_sha256 FROM {customer}")
def file_digests(spark, d):
    files = model(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.encode(F.concat_ws("\n", "c_name", "c_mktsegment"), "UTF-8").alias("content"))
    return readers.csv_lines(files).where("line_no = 0").select("path", "file_sha256")


def preset_sql() -> str:
    from ..sources.generators import PRESETS

    return "VALUES " + ", ".join(f"('{k}', {v['angle']}::DOUBLE, {v['noise']}, {v['jpeg']})" for k, v in PRESETS.items())


@query(f"SELECT p AS preset, a AS angle, CAST(n AS INTEGER) AS noise, CAST(j AS INTEGER) AS jpeg FROM ({preset_sql()}) t(p, a, n, j)")
def degradation_presets(spark, d):
    from ..sources.generators import PRESETS, degradation

    names = spark.createDataFrame([(k,) for k in PRESETS], "preset string")
    return names.select("preset", degradation(F.col("preset"), "angle").alias("angle"), *(degradation(F.col("preset"), c).cast("int").alias(c) for c in ("noise", "jpeg")))

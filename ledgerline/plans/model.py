"""The engine's tables derived from the driver's tables, as SQL that both engines run.

A placeholder {name} is another table of the model or one of the files. Everything follows from keys, so both engines see
the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FILES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"}


def _case(n: str, values: list[str]) -> str:
    return f"CASE CAST({n} AS INT) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Invented names: a head (also in half-width kana), a tail and a number.
HEADS = ["ミナト", "アオイ", "カモメ", "ツキノ", "イサミ", "ホトリ", "ソラノ"]
HALVES = ["ﾐﾅﾄ", "ｱｵｲ", "ｶﾓﾒ", "ﾂｷﾉ", "ｲｻﾐ", "ﾎﾄﾘ", "ｿﾗﾉ"]
TAILS = ["製菓", "織物", "ｶﾋﾞﾝ", "漆器", "倉庫", "園芸", "測量", "造船", "うつわ", "書房", "香料", "染色"]

MODEL = {
    "organizations": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS organization_id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'cus_' || CAST(r_regionkey AS STRING) END AS stripe_customer_id, r_regionkey = 4 AS billing_exempt FROM {region}",
    "clients": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS client_id, CAST(n_regionkey + 1 AS BIGINT) AS organization_id, n_name AS name, CAST(n_nationkey % 2 + 1 AS INT) AS default_direction, CASE WHEN n_nationkey % 3 = 0 THEN 'tesseract' ELSE 'vision' END AS ocr_engine FROM {nation}",
    "cores": f"SELECT CAST(p_partkey AS BIGINT) AS partner_id, {_case('p_partkey % 7', HEADS)} AS head, {_case('p_partkey % 7', HALVES)} AS half, {_case('floor(p_partkey / 7.0) % 12', TAILS)} AS tail, CASE WHEN p_partkey >= 84 THEN CAST(CAST(floor(p_partkey / 84.0) AS BIGINT) AS STRING) ELSE '' END AS num FROM {{part}}",
    "partners": "SELECT partner_id, partner_id % 25 + 1 AS client_id, head || tail || num AS core, CASE CAST(partner_id % 5 AS INT) WHEN 0 THEN '株式会社' || head || tail || num WHEN 1 THEN head || tail || num || '株式会社' WHEN 2 THEN '(株)' || head || tail || num WHEN 3 THEN head || '・' || tail || num || '㈱' ELSE '有限会社 ' || head || tail || num END AS name FROM {cores}",
    "aliases": "SELECT partner_id AS alias_id, partner_id, CASE WHEN partner_id % 4 = 0 THEN '（株）' || half || tail || num ELSE head || tail END AS alias, CAST(partner_id % 3 AS INT) AS source FROM {cores} WHERE partner_id % 2 = 0",
    "queries": "SELECT c.query_id, p.client_id, p.partner_id AS truth_id, CASE WHEN c.query_id % 4 = 0 THEN p.name ELSE substr(p.core, 1, CAST(1 + c.query_id % 3 AS INT)) || substr(p.core, CAST(3 + c.query_id % 3 AS INT)) END AS text FROM (SELECT c_custkey AS query_id, c_custkey * 7919 % n AS pid FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {part}) parts) c JOIN {partners} p ON p.partner_id = c.pid",
    "docs": "SELECT CAST(o_orderkey AS BIGINT) AS document_id, o_custkey % 25 + 1 AS client_id, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS direction, CAST(o_orderkey % 3 + 1 AS INT) AS doc_type, 'scan_' || CAST(CAST(floor(o_orderkey / 3.0) AS BIGINT) AS STRING) AS source_name, CAST(o_orderkey % 3 AS INT) AS source_page, 0 AS source_region, CAST(round(o_totalprice) AS BIGINT) AS total, CAST(o_orderdate AS DATE) AS issue_date, o_custkey % 25 + 25 * (o_orderkey % 7) AS partner_id FROM {orders}",
    "fields": "SELECT document_id, 'total' AS field_key, CASE WHEN document_id % 31 = 0 THEN 'unread' ELSE CAST(total AS STRING) END AS value, document_id * 10 AS id FROM {docs} UNION ALL SELECT document_id, 'issue_date', CASE WHEN document_id % 29 = 0 THEN '' ELSE CAST(issue_date AS STRING) END, document_id * 10 + 1 FROM {docs} UNION ALL SELECT d.document_id, 'issuer_name', p.core, d.document_id * 10 + 2 FROM {docs} d JOIN {partners} p ON p.partner_id = d.partner_id UNION ALL SELECT document_id, 'recipient_name', 'テスト商事' || CAST(client_id AS STRING), document_id * 10 + 3 FROM {docs} UNION ALL SELECT document_id, 'total', '1', document_id * 10 + 4 FROM {docs} WHERE document_id % 3 = 0",
    "candidates": "SELECT d.document_id, d.partner_id + r.r_regionkey AS partner_id, CAST(r.r_regionkey + 1 AS INT) AS rank, CAST(CASE WHEN d.document_id * 37 % 10001 < 1400 THEN 1400 ELSE d.document_id * 37 % 10001 END - 700 * r.r_regionkey AS DECIMAL(12,2)) / 100 AS raw_score, 'form' || CAST((d.partner_id + r.r_regionkey) % 50 AS STRING) AS matched FROM {docs} d CROSS JOIN {region} r WHERE r.r_regionkey < 3 AND d.document_id % 19 <> 0",
    "scores": "SELECT document_id, partner_id, rank, CAST(raw_score AS DOUBLE) AS score, matched FROM {candidates}",
    "results": "SELECT d.document_id, d.client_id, d.doc_type, d.partner_id, CASE CAST(d.document_id % 8 AS INT) WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 5 ELSE 1 END AS decision, CASE WHEN d.document_id % 8 < 3 THEN d.document_id % 4 + 1 END AS decided_by, d.issue_date AS decided_at FROM {docs} d",
    "transactions": "SELECT d.document_id AS transaction_id, d.client_id, CASE WHEN d.document_id % 4 = 0 THEN 1000 ELSE 0 END + d.document_id % 97 AS batch_id, CASE WHEN d.document_id % 7 = 0 THEN 2 ELSE 1 END AS source_type, CASE WHEN d.document_id % 11 = 0 THEN 1 ELSE 2 END AS direction, greatest(CAST(1 AS BIGINT), d.total - CASE CAST(d.document_id % 5 AS INT) WHEN 2 THEN 440 WHEN 3 THEN 880 WHEN 4 THEN 1500 ELSE 0 END) AS amount, d.issue_date + CAST(d.document_id % 90 - 8 AS INT) AS transaction_date, CASE WHEN d.document_id % 4 = 0 THEN substr(p.head || p.tail || p.num, 1, 3) ELSE 'カ)' || p.head || p.tail || p.num END AS description, CASE WHEN d.document_id % 4 = 0 THEN substr(p.head || p.tail || p.num, 1, 3) ELSE p.head || p.tail || p.num END AS raw_name FROM {docs} d JOIN {cores} p ON p.partner_id = d.partner_id",
    "settlements": "SELECT document_id, document_id + CASE WHEN document_id % 34 = 0 THEN 1 ELSE 0 END AS transaction_id, CASE WHEN document_id % 13 = 0 THEN 2 WHEN document_id % 51 = 0 THEN 5 WHEN document_id % 17 = 0 THEN 1 ELSE 3 END AS status FROM {docs} WHERE document_id % 13 = 0 OR document_id % 17 = 0 OR document_id % 10 = 0",
    "thresholds": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS threshold_id, CAST(n_regionkey + 1 AS BIGINT) AS organization_id, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey + 1 AS BIGINT) END AS client_id, CASE WHEN n_nationkey % 7 = 0 THEN CAST(n_nationkey AS BIGINT) END AS partner_id, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey % 3 + 1 AS INT) END AS doc_type, CAST(80 + n_nationkey AS DOUBLE) AS upper, CAST(40 + n_nationkey AS DOUBLE) AS lower, DATE '2020-01-01' + CAST(n_nationkey * 10 AS INT) AS valid_from, CASE WHEN n_nationkey % 5 = 0 THEN DATE '2020-12-31' END AS valid_to FROM {nation}",
    "reg_checks": "SELECT document_id, CASE WHEN document_id % 9 = 0 THEN NULL ELSE 'T' || lpad(CAST((document_id % 40 + 1) * 76543210987 % 9999999999999 AS STRING), 13, '1') END AS reg_no, CAST(document_id % 6 + 1 AS INT) AS status FROM {docs}",
    "jobs": "SELECT CAST(event_id AS BIGINT) AS job_id, CAST(user_id AS BIGINT) AS document_id, CAST(event_id % 4 + 1 AS INT) AS status, CAST(event_id % 3 + 1 AS INT) AS attempts, CAST(ts AS TIMESTAMP) AS run_after FROM {events}",
    "audit": "SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id % 5 + 1 AS BIGINT) AS organization_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS actor_id, 'documents' AS target_table, CAST(user_id AS BIGINT) AS target_id, event_type AS action, CASE WHEN event_id % 2 = 0 THEN props END AS before, '{{\"value\": ' || CAST(event_id AS STRING) || '}}' AS after, CAST(NULL AS BIGINT) AS threshold_id, CAST(ts AS TIMESTAMP) AS occurred_at FROM {events}",
    "subscriptions": "SELECT CAST(event_id AS BIGINT) AS subscription_id, CAST(user_id % 7 + 1 AS BIGINT) AS organization_id, 'cus_' || CAST(user_id % 9 AS STRING) AS customer_id, CASE CAST(event_id % 10 AS INT) WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' WHEN 3 THEN 'unpaid' WHEN 4 THEN 'canceled' WHEN 5 THEN 'incomplete' WHEN 6 THEN 'incomplete_expired' WHEN 7 THEN 'paused' WHEN 8 THEN 'new_state' END AS status, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS TIMESTAMP) END AS grace_until FROM {events}",
    "statement_rows": "SELECT CAST(event_id AS BIGINT) AS line_no, CAST(user_id % 20 AS STRING) AS file_id, user_id % 20 AS batch_id, user_id % 25 + 1 AS client_id, 1 AS source_type, CAST(ts AS DATE) AS transaction_date, CAST(floor(value) AS BIGINT) % 50 + 1 AS amount, CAST(event_id % 2 + 1 AS INT) AS direction, event_type AS description FROM {events}",
    "judged": "SELECT document_id, score, document_id % 7 <> 0 AND score > 20 AS correct, CASE WHEN score >= 95 THEN 1 WHEN score >= 55 THEN 5 ELSE 4 END AS decision FROM {scores} WHERE rank = 1",
}


def needs(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}", sql)


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in FILES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(MODEL[name], **{n: model(spark, sf_dir, n) for n in set(needs(MODEL[name]))})


def with_model(body: str) -> str:
    """body with the model tables that it names by {placeholders}, as one statement."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in needs(sql):
            if n in MODEL and n not in order:
                visit(MODEL[n])
                if n not in order:
                    order.append(n)

    visit(body)
    fill = lambda sql: re.sub(r"(?<!\{)\{(\w+)\}", lambda m: ("m_" if m[1] in MODEL else "") + m[1], sql).replace("{{", "{").replace("}}", "}")
    ctes = [f"m_{n} AS ({fill(MODEL[n])})" for n in order]
    text = fill(body).strip()
    if not ctes:
        return text
    return f"WITH {', '.join(ctes)}{', ' + text[5:] if text.upper().startswith('WITH ') else ' ' + text}"

"""Row functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import extract
from ..sources import generators, images, readers
from .model import model
from .registry import query
from .sqltext import lit

DIGITS13 = "lpad(CAST(p_partkey * 98765432101 % 9999999999999 AS STRING), 13, '0')"
RAW_REG = f"CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '登録番号 T' || {DIGITS13} WHEN 1 THEN 'ｔ' || {DIGITS13} WHEN 2 THEN {DIGITS13} WHEN 3 THEN 'T' || substr({DIGITS13}, 1, 12) ELSE '' END"
NORMAL = f"regexp_replace(translate({RAW_REG}, 'tＴｔ', 'TTT'), '[^T0-9]', '', 'g')"
WEIGHTED = " + ".join(f"CAST(substr(n, {15 - i}, 1) AS INT) * {1 if i % 2 else 2}" for i in range(1, 13))


@query(f"SELECT p_partkey, CASE WHEN n = '' THEN 1 WHEN NOT regexp_matches(n, '^T[0-9]{{{{13}}}}$') THEN 2 WHEN CAST(substr(n, 2, 1) AS INT) <> 9 - ({WEIGHTED}) % 9 THEN 3 ELSE 4 END AS status FROM (SELECT p_partkey, {NORMAL} AS n FROM {{part}})")
def reg_status(spark, d):
    raw = spark.sql(f"SELECT p_partkey, {RAW_REG} AS raw FROM {{part}}", part=model(spark, d, "part"))
    return raw.select("p_partkey", values.reg_status(F.col("raw")).alias("status"))


@query(f"SELECT p_partkey, CAST(substr(n, 2, 1) AS INT) = 9 - ({WEIGHTED}) % 9 AS ok FROM (SELECT p_partkey, 'T' || {DIGITS13} AS n FROM {{part}})")
def reg_check_digit(spark, d):
    raw = spark.sql(f"SELECT p_partkey, {DIGITS13} AS n FROM {{part}}", part=model(spark, d, "part"))
    return raw.select("p_partkey", values.check_digit_ok(F.col("n")).alias("ok"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN 'T' || {DIGITS13} ELSE '' END AS reg_no FROM {{part}}")
def reg_extract(spark, d):
    raw = spark.sql(f"SELECT p_partkey, {RAW_REG} AS raw FROM {{part}}", part=model(spark, d, "part"))
    return raw.select("p_partkey", text.find_reg_no(F.col("raw")).alias("reg_no"))


DATES = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN y || '/' || m || '/' || a WHEN 1 THEN y || '年' || m || '月' || a || '日' WHEN 2 THEN y || '-' || m || '-' || a WHEN 3 THEN y || lpad(m, 2, '0') || lpad(a, 2, '0') ELSE '繰越' END"
PARTS = "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS STRING) AS y, CAST(extract(month FROM o_orderdate) AS STRING) AS m, CAST(extract(day FROM o_orderdate) AS STRING) AS a, o_orderdate, o_totalprice FROM {orders}"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS day FROM {orders}")
def parse_dates(spark, d):
    raw = spark.sql(f"SELECT o_orderkey, {DATES} AS s FROM ({PARTS})", orders=model(spark, d, "orders"))
    return raw.select("o_orderkey", values.ledger_date(F.col("s")).alias("day"))


ERA = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '発行 ' || y || '年' || m || '月' || a || '日' WHEN 1 THEN '令和' || CAST(o_orderkey % 9 + 1 AS STRING) || '年' || m || '月' || a || '日' WHEN 2 THEN 'R' || CAST(o_orderkey % 9 + 1 AS STRING) || '.' || m || '.' || a ELSE '９月' END"


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '' ELSE CAST(2018 + o_orderkey % 9 + 1 AS VARCHAR) || strftime(o_orderdate, '-%m-%d') END AS day FROM {orders}")
def parse_recognised_dates(spark, d):
    raw = spark.sql(f"SELECT o_orderkey, {ERA} AS s FROM ({PARTS})", orders=model(spark, d, "orders"))
    return raw.select("o_orderkey", values.recognised_date(F.col("s")).alias("day"))


AMOUNT = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '¥' || CAST(v AS STRING) || '-' WHEN 1 THEN CAST(v AS STRING) || '-88' WHEN 2 THEN '▲' || CAST(v AS STRING) ELSE '' END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 OR length(CAST(v AS VARCHAR)) < 3 THEN -1 ELSE v END AS recognised, CASE o_orderkey % 4 WHEN 0 THEN v WHEN 1 THEN v * 100 + 88 WHEN 2 THEN -v ELSE 0 END AS ledger FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS v FROM {orders})")
def parse_amounts(spark, d):
    raw = spark.sql(f"SELECT o_orderkey, {AMOUNT} AS s FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS v FROM {{orders}})", orders=model(spark, d, "orders"))
    return raw.select("o_orderkey", values.recognised_amount(F.col("s")).alias("recognised"), values.ledger_amount(F.col("s")).alias("ledger"))


ACTIONS = {1: "auto_approve", 2: "approve", 3: "correct", 4: "reject", 5: "needs_review"}


def _case(code: str, names: dict[int, str]) -> str:
    return f"CASE {code} {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in names.items())} END"


@query(f"SELECT document_id, {', '.join(f'{_case('document_id % 10', names)} AS {kind}' for kind, names in values.LABELS.items())}, {_case('decision', ACTIONS)} AS action FROM {{results}}")
def label_maps(spark, d):
    """All maps, over every code from 0 to 9."""
    r = model(spark, d, "results")
    code = F.col("document_id") % 10
    return r.select("document_id", *(values.label(code, names).alias(kind) for kind, names in values.LABELS.items()), values.decision_action(F.col("decision")).alias("action"))


@query("SELECT partner_id, CASE CAST(partner_id % 5 AS INT) WHEN 4 THEN 'yugen' ELSE 'kabushiki' END AS kind FROM {partners}")
def corp_kinds(spark, d):
    return model(spark, d, "partners").select("partner_id", text.corp_kind(F.col("name")).alias("kind"))


BANKED = "CASE CAST(partner_id % 4 AS INT) WHEN 0 THEN 'ｶ)' || half WHEN 1 THEN half || '(ｶ' WHEN 2 THEN 'ﾌﾘｺﾐ ﾕ)' || half ELSE 'ﾃﾞﾋﾞｯﾄ ' || half END"


@query("SELECT partner_id, head AS norm FROM {cores}")
def bank_normalize(spark, d):
    raw = spark.sql(f"SELECT partner_id, {BANKED} AS s FROM {{cores}}", cores=model(spark, d, "cores"))
    return raw.select("partner_id", text.normalize(F.col("s"), bank=True).alias("norm"))


@query("SELECT partner_id, CASE WHEN partner_id % 2 = 0 THEN head || tail ELSE head || tail || 'A1' END AS name FROM {cores}")
def tidy_names(spark, d):
    raw = spark.sql("SELECT partner_id, CASE WHEN partner_id % 2 = 0 THEN head || tail || CASE WHEN partner_id % 4 = 0 THEN '御中' ELSE 'ab' END ELSE head || tail || 'A1様 3' END AS s FROM {cores}", cores=model(spark, d, "cores"))
    return raw.select("partner_id", text.tidy_name(F.col("s")).alias("name"))


@query(f"SELECT partner_id, translate(name, '{text.VOICED}', '{text.VOICELESS}') AS bare FROM {{partners}}")
def strip_voicing(spark, d):
    return model(spark, d, "partners").select("partner_id", text.strip_voicing(F.col("name")).alias("bare"))


@query("SELECT event_id, percent FROM (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE round(100.0::DOUBLE * (event_id % 7) / (user_id % 5), 1) END AS percent FROM {events})")
def percents(spark, d):
    return model(spark, d, "events").select("event_id", values.percent(F.col("event_id") % 7, F.col("user_id") % 5).alias("percent"))


WORDS = {"corporate": text.CORPORATE, "title": text.TITLES, "contact": text.CONTACTS, "address": text.ADDRESSES, "label": text.LABELS}
VALUES = ["¥1,000-", "１２：３０", "2026年7月1日", "(1)/2", "INV-0", "ab_12", "A-1", "x 1", "合 1"]
KIND = "[" + ", ".join(lit(w) for ws in WORDS.values() for w in ws) + ", '']"


def _has(s: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({s}, {lit(w)})" for w in words) + ")"


@query(f"""WITH r AS (SELECT partner_id AS document_id, head || list_extract({KIND}, CAST(1 + partner_id % {1 + sum(map(len, WORDS.values()))} AS INT)) || tail AS s, list_extract([{', '.join(map(lit, VALUES))}], CAST(1 + partner_id % {len(VALUES)} AS INT)) AS v FROM {{{{cores}}}})
SELECT document_id, {_has("s", text.CORPORATE)} AS corporate, NOT {_has("s", text.CORPORATE)} AND {_has("s", text.TITLES)} AS title, {_has("s", text.CONTACTS)} AS contact, {_has("s", text.ADDRESSES)} AS address, {_has("s", text.LABELS)} AS label,
  v IN ('¥1,000-', '１２：３０', '2026年7月1日', '(1)/2') AS numeric, v IN ('INV-0', 'ab_12') AS doc_no FROM r""".replace("{{cores}}", "{cores}"))
def lexical_predicates(spark, d):
    """Every word of each kind within a name, and values that are numbers, document numbers or neither."""
    k = F.col("partner_id")
    of = lambda items: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    s, v = F.concat("head", of([*(w for ws in WORDS.values() for w in ws), ""]), "tail"), of(VALUES)
    tests = {"corporate": text.has_corporate(s), "title": text.looks_like_title(s), "contact": text.looks_like_contact(s), "address": text.looks_like_address(s), "label": text.looks_like_label(s), "numeric": text.looks_numeric(v), "doc_no": text.looks_like_doc_no(v)}
    return model(spark, d, "cores").select(k.alias("document_id"), *(c.alias(n) for n, c in tests.items()))


VISION_ROW = """'{{"responses":[{{"fullTextAnnotation":{{"pages":[{{"blocks":[{{"paragraphs":[{{"words":[{{"confidence":0.5,"boundingBox":{{"vertices":[{{"x":' || CAST(k % 50 AS STRING) || ',"y":7}},{{"x":90,"y":30}}]}},"symbols":[{{"text":"' || a || '"}},{{"text":"Z"}}]}},{{"confidence":0.25,"boundingBox":{{"vertices":[{{"y":5}},{{"x":4,"y":9}}]}},"symbols":[{{"text":"q"}}]}}]}}]}}]}}]}}}}]}}'"""


@query("SELECT CAST(c_custkey AS BIGINT) AS document_id, CAST(s AS INTEGER) AS seq, CASE s WHEN 0 THEN c_mktsegment || 'Z' ELSE 'q' END AS text, CAST(CASE s WHEN 0 THEN c_custkey % 50 ELSE 0 END AS INTEGER) AS x, CAST(CASE s WHEN 0 THEN 7 ELSE 5 END AS INTEGER) AS y, CAST(CASE s WHEN 0 THEN 90 - c_custkey % 50 ELSE 4 END AS INTEGER) AS w, CAST(CASE s WHEN 0 THEN 23 ELSE 4 END AS INTEGER) AS h FROM {customer}, (VALUES (0), (1)) t(s)")
def vision_flatten(spark, d):
    body = spark.sql(f"SELECT k AS document_id, {VISION_ROW} AS body FROM (SELECT CAST(c_custkey AS BIGINT) AS k, c_mktsegment AS a FROM {{customer}})", customer=model(spark, d, "customer"))
    return readers.vision_blocks(body).select("document_id", "seq", "text", "x", "y", "w", "h")


@query("""WITH d AS (SELECT d.document_id AS k, d.client_id, d.total, d.issue_date, p.name FROM {docs} d JOIN {partners} p USING (partner_id))
SELECT k AS document_id, unnest(['issuer_name', 'recipient_name', 'partner_name', 'reg_no', 'issue_date', 'total', 'doc_no']) AS field_key,
  unnest([name, '青葉会' || CAST(client_id AS VARCHAR), '青葉会' || CAST(client_id AS VARCHAR), CASE WHEN k % 3 <> 1 THEN 'T9234567890' || CAST(100 + k % 900 AS VARCHAR) END, strftime(issue_date, '%Y-%m-%d'), CAST(total AS VARCHAR), 'INV-' || CAST(k AS VARCHAR)]) AS value
FROM d""".replace("FROM d", "FROM d) WHERE value IS NOT NULL").replace("SELECT k AS", "SELECT * FROM (SELECT k AS"))
def extract_fields(spark, d):
    """A page of each document, in three layouts: with a registration number or without, three notations of dates, totals in
    two notations beside a subtotal, corporate forms before and after names."""
    docs, cores = model(spark, d, "docs"), model(spark, d, "partners")
    named, k = docs.join(cores.select("partner_id", "name"), "partner_id"), F.col("document_id")
    block = lambda seq, s, x, y, w=120, h=20: F.struct(F.lit(seq).alias("seq"), s.alias("text"), F.lit(0.9).alias("confidence"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    date = F.when(k % 3 == 0, F.date_format("issue_date", "yyyy年M月d日")).when(k % 3 == 1, F.date_format("issue_date", "yyyy/MM/dd")).otherwise(F.date_format("issue_date", "yyyy.M.d"))
    total = F.when(k % 3 == 1, F.concat(F.col("total").cast("string"), F.lit("円"))).otherwise(F.concat(F.lit("¥"), F.col("total").cast("string"), F.lit("-")))
    reg = F.when(k % 3 == 1, " ").otherwise(F.concat(F.lit("登録番号 T9234567890"), (k % 900 + 100).cast("string")))
    page = F.array(
        block(0, F.lit("請求書"), 300, 10), block(1, F.concat(F.lit("青葉会"), F.col("client_id").cast("string")), 20, 60), block(2, F.lit("御中"), 150, 60, 40), block(3, F.col("name"), 500, 60, 150), block(4, F.lit("TEL 03-0000-0000"), 500, 90, 150),
        block(5, reg, 500, 120, 150), block(6, date, 20, 100), block(7, F.lit("小計"), 20, 460, 40), block(8, F.lit("¥1,234"), 200, 460), block(9, F.lit("合計"), 20, 500, 40), block(10, total, 200, 500), block(11, F.concat(F.lit("No. INV-"), k.cast("string")), 300, 100),
    )
    blocks = named.select("document_id", F.explode(page).alias("b")).select("document_id", "b.*")
    return extract.extract_fields(blocks).select("document_id", "field_key", "value")


def _listed(items: list[str]) -> str:
    return f"[{', '.join(map(lit, items))}]"


_PICK = lambda items, seed: f"list_extract({_listed(items)}, CAST(CAST(('0x' || substr(md5('{seed}:' || CAST(id AS VARCHAR)), 1, 15)) AS BIGINT) % {len(items)} + 1 AS INT))"


@query(f"""WITH m AS (SELECT id, {_PICK(generators.HEADS, generators.SEED)} || {_PICK(generators.TAILS, generators.SEED + 1)} || CASE WHEN id % 3 = 0 THEN CAST(id % 999 + 1 AS VARCHAR) ELSE '' END AS name FROM (SELECT CAST(p_partkey + 1 AS BIGINT) AS id FROM {{part}})),
  s AS (SELECT id, unnest([0, 1, 2, 3, 4]) AS shape, unnest([name, 'カ)' || name, name || '(カ', 'フリコミ ' || name, 'フリコミ' || name]) AS whole FROM m)
SELECT id AS partner_id, shape, CAST(t AS INTEGER) AS trunc, CASE WHEN t = 0 THEN whole ELSE substr(whole, 1, t) END AS text, CAST(length(whole) AS INTEGER) AS full_len, t > 0 AND length(whole) > t AS cut FROM s, (SELECT unnest({generators.TRUNCATIONS}) AS t)""")
def generate_descriptions(spark, d):
    return generators.descriptions(generators.masters(spark, model(spark, d, "part").count()))


@query("SELECT page_id, CAST(i AS INTEGER) AS region, CAST(300 * i // n AS INTEGER) AS x, CAST(300 // n AS INTEGER) AS w FROM (SELECT page_id, page_id % 3 + 1 AS n FROM {pages}), (SELECT unnest([0, 1, 2]) AS i) WHERE i < n")
def split_pages(spark, d):
    """Pages drawn from keys, each with one to three columns of ink, to the regions found on them."""
    import pandas as pd

    def run(batches):
        import numpy as np

        for b in batches:
            rows = []
            for k in b["page_id"]:
                page = np.full((200, 300), 255, np.uint8)
                n = int(k) % 3 + 1
                for i in range(n):
                    page[20:180, 300 * i // n + 20 : 300 * (i + 1) // n - 20] = np.where(np.indices((160, 300 * (i + 1) // n - 300 * i // n - 40)).sum(0) % 4 == 0, 0, 255)
                rows += [(k, i, x, w) for i, (x, _, w, _) in enumerate(images.split_page(page))]
            yield pd.DataFrame(rows, columns=["page_id", "region", "x", "w"])

    return model(spark, d, "pages").select("page_id").mapInPandas(run, "page_id long, region int, x int, w int")

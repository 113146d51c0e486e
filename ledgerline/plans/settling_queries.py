"""Ledger import, settlement, ambiguity, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import audit, ledger, settlement
from ..operators.staging import passes, share, spread, staged, staged_in_turn
from .model import model
from .registry import query
from .sqltext import combined, grams, metrics, norm

TARGETS = """t AS (
  SELECT d.document_id, d.client_id, try_cast(f.total AS BIGINT) AS total, try_cast(f.issue_date AS DATE) AS issue_date, f.issuer_name FROM {docs} d JOIN (
    SELECT document_id, min_by(value, id) FILTER (field_key = 'total') AS total, min_by(value, id) FILTER (field_key = 'issue_date') AS issue_date, min_by(value, id) FILTER (field_key = 'issuer_name') AS issuer_name FROM {fields} GROUP BY document_id) f USING (document_id)
  WHERE d.direction = 1 AND try_cast(f.total AS BIGINT) > 0 AND d.document_id NOT IN (SELECT document_id FROM {settlements} WHERE status IN (2, 5)))"""
TX = f"x AS (SELECT *, {norm('raw_name')} AS nn FROM {{transactions}})"
BAND = f"""{TARGETS}, {TX}, band AS (
  SELECT t.*, x.transaction_id, x.source_type, x.amount, x.transaction_date, x.nn FROM t JOIN x ON t.client_id = x.client_id AND x.direction = 2
    AND (x.amount = t.total OR (x.source_type = 1 AND x.amount BETWEEN t.total - 880 AND t.total))
    AND (t.issue_date IS NULL OR x.transaction_date BETWEEN t.issue_date - 5 AND t.issue_date + 75))"""
LIMITS = f"""lim AS (SELECT *, length(description) AS len, max(length(description)) OVER (PARTITION BY batch_id) AS mx FROM x),
  cut AS (SELECT *, len >= mx AND nn <> '' AND sum(CAST(len = mx AS INT)) OVER (PARTITION BY batch_id) >= 2 AS at_limit FROM lim),
  p AS (SELECT client_id, name, norm, translate(norm, '{text.VOICED}', '{text.VOICELESS}') AS bare FROM (SELECT client_id, name, {norm("name")} AS norm FROM {{partners}} UNION ALL SELECT p.client_id, p.name, {norm("a.alias")} FROM {{aliases}} a JOIN {{partners}} p USING (partner_id))),
  amb AS (SELECT transaction_id, count(DISTINCT name) AS n_names FROM cut JOIN p ON at_limit AND p.client_id = cut.client_id AND (starts_with(p.norm, nn) OR starts_with(p.bare, translate(nn, '{text.VOICED}', '{text.VOICELESS}'))) GROUP BY 1 HAVING count(DISTINCT name) >= 2)"""
NAMES = f"""form AS (SELECT document_id, {norm("issuer_name")} AS fn FROM t UNION SELECT t.document_id, {norm("a.alias")} FROM t JOIN {{docs}} d USING (document_id) JOIN {{aliases}} a ON a.partner_id = d.partner_id),
  ns AS (SELECT document_id, transaction_id, coalesce(max(score) FILTER (ok), 0) AS name_score FROM (
    SELECT document_id, transaction_id, len(list_intersect(ga, gb)) > 0 AS ok, {combined()} AS score FROM (
      SELECT *, {metrics("nn", "fn", "ga", "gb")} FROM (SELECT b.document_id, b.transaction_id, b.nn, f.fn, {grams("b.nn")} AS ga, {grams("f.fn")} AS gb FROM band b JOIN form f USING (document_id)))) GROUP BY ALL)"""
CANDIDATES = f"""{BAND}, {LIMITS}, {NAMES}, sc AS (
  SELECT *, 0.4::DOUBLE * name_score + 0.35::DOUBLE * amount_score + 0.25::DOUBLE * date_score AS score FROM (
    SELECT b.document_id, b.transaction_id, b.transaction_date, CASE WHEN a.n_names IS NOT NULL THEN least(ns.name_score, 80) ELSE ns.name_score END AS name_score, a.n_names IS NOT NULL AND ns.name_score > 80 AS capped,
      CASE WHEN b.total = b.amount THEN 100 WHEN b.source_type = 1 AND b.total - b.amount BETWEEN 1 AND 880 THEN 70 ELSE 0 END::DOUBLE AS amount_score,
      CASE WHEN b.issue_date IS NULL THEN 50 WHEN b.source_type = 2 THEN CASE WHEN dd = 0 THEN 100 WHEN dd BETWEEN 1 AND 3 THEN 80 ELSE 30 END WHEN dd BETWEEN 0 AND 45 THEN 100 WHEN dd BETWEEN 46 AND 75 THEN 80 WHEN dd BETWEEN -5 AND -1 THEN 60 ELSE 30 END::DOUBLE AS date_score
    FROM (SELECT *, transaction_date - issue_date AS dd FROM band) b JOIN ns USING (document_id, transaction_id) LEFT JOIN amb a USING (transaction_id)))"""
DECIDED = f"""{CANDIDATES}, pick AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY round(score, 9) DESC, transaction_date, transaction_id) = 1),
  dec AS (SELECT document_id, CASE WHEN score >= 95 THEN 1 WHEN score >= 55 THEN 3 ELSE 4 END AS status, CASE WHEN score >= 55 THEN transaction_id END AS transaction_id, CASE WHEN score >= 55 THEN score END AS score FROM t LEFT JOIN pick USING (document_id))"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    tables = [model(spark, d, name) for name in ("docs", "fields", "settlements")]
    n = passes(tables[0])
    return staged_in_turn([settlement.targets(*(share(t, i, n, "document_id") for t in tables), ("partner_id",)) for i in range(n)], "targets")


def formed(spark: SparkSession, d: str) -> DataFrame:
    return settlement.with_forms(docs(spark, d), model(spark, d, "aliases"))


def txs(spark: SparkSession, d: str) -> DataFrame:
    return settlement.normalized(staged(model(spark, d, "transactions"), "transactions"), "raw_name", "normalized_name")


def doc_forms(spark: SparkSession, d: str, t: DataFrame) -> DataFrame:
    alias = model(spark, d, "docs").select("document_id", "partner_id").join(model(spark, d, "aliases"), "partner_id").select("document_id", F.col("alias").alias("form"))
    forms = t.select("document_id", F.col("issuer_name").alias("form")).union(alias.join(t.select("document_id"), "document_id", "left_semi"))
    return spread(forms.select("document_id", text.normalize(F.col("form")).alias("norm")), "document_id").distinct()


def partner_forms(spark: SparkSession, d: str) -> DataFrame:
    p, a = model(spark, d, "partners"), model(spark, d, "aliases")
    both = p.select("client_id", "name", F.col("name").alias("form")).unionByName(a.join(p, "partner_id").select("client_id", "name", F.col("alias").alias("form")))
    return spread(both, "name").select("client_id", "name", text.normalize(F.col("form")).alias("norm"))


def scored(spark: SparkSession, d: str, want: list[str]) -> DataFrame:
    return settlement.candidates(formed(spark, d), txs(spark, d), None, partner_forms(spark, d), want)


def best(spark: SparkSession, d: str, t: DataFrame, want: list[str] = settlement.CANDIDATE) -> DataFrame:
    """t: formed()."""
    return settlement.best_candidates(t, txs(spark, d), None, partner_forms(spark, d), want)


ROWS = "SELECT *, CAST(row_number() OVER (PARTITION BY file_id, transaction_date, amount, direction, description ORDER BY line_no) - 1 AS INTEGER) AS occurrence FROM {statement_rows}"
PRINTS = f"SELECT *, sha256(concat_ws('|', CAST(source_type AS VARCHAR), strftime(transaction_date, '%Y-%m-%d'), CAST(amount AS VARCHAR), CAST(direction AS VARCHAR), description, CAST(occurrence AS VARCHAR))) AS row_fingerprint FROM ({ROWS})"


@query(ROWS.replace("*,", "line_no, file_id,", 1))
def ledger_occurrences(spark, d):
    return ledger.occurrences(model(spark, d, "statement_rows")).select("line_no", "file_id", "occurrence")


@query(f"SELECT line_no, row_fingerprint FROM ({PRINTS})")
def ledger_fingerprint(spark, d):
    return ledger.canonical(model(spark, d, "statement_rows")).select("line_no", "row_fingerprint")


def imported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = ledger.canonical(model(spark, d, "statement_rows"))
    return ledger.import_rows(rows.where("batch_id >= 5"), rows.where("batch_id < 5"))


IMPORT = f"""WITH r AS ({PRINTS}), m AS (SELECT *, batch_id >= 5 AND row_number() OVER (PARTITION BY client_id, row_fingerprint, batch_id >= 5 ORDER BY batch_id, line_no) = 1
  AND (client_id, row_fingerprint) NOT IN (SELECT client_id, row_fingerprint FROM r WHERE batch_id < 5) AS fresh FROM r)"""


@query(f"{IMPORT} SELECT batch_id, line_no, row_fingerprint FROM m WHERE fresh")
def ledger_dedupe_import(spark, d):
    return imported(spark, d)[0].select("batch_id", "line_no", "row_fingerprint")


@query(f"{IMPORT} SELECT batch_id, count(*) FILTER (fresh) AS inserted, count(*) FILTER (NOT fresh) AS skipped FROM m WHERE batch_id >= 5 GROUP BY batch_id")
def ledger_import_counts(spark, d):
    return imported(spark, d)[1]


@query(f"WITH {TARGETS} SELECT document_id, client_id, total, issue_date, issuer_name FROM t")
def settle_targets(spark, d):
    return docs(spark, d).drop("partner_id")


@query(f"WITH {BAND} SELECT document_id, transaction_id FROM band")
def settle_band_join(spark, d):
    return settlement.band_join(docs(spark, d), txs(spark, d)).select("document_id", "transaction_id")


@query(f"WITH {BAND}, {NAMES} SELECT document_id, transaction_id, round(name_score, 6) AS name_score FROM ns")
def settle_name_score(spark, d):
    t = docs(spark, d)
    pairs = staged(settlement.band_join(t, txs(spark, d)), "pairs")
    return settlement.name_scores(pairs, doc_forms(spark, d, t)).select("document_id", "transaction_id", F.round("name_score", 6).alias("name_score"))


@query(f"WITH {CANDIDATES} SELECT document_id, transaction_id, round(name_score, 6) AS name_score, amount_score, date_score, round(score, 6) AS score, capped FROM sc")
def settle_score(spark, d):
    s = scored(spark, d, ["document_id", "transaction_id", "name_score_6", "amount_score", "date_score", "score_6", "capped"])
    return s.withColumnsRenamed({"name_score_6": "name_score", "score_6": "score"})


@query(f"WITH {CANDIDATES} SELECT document_id, transaction_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY round(score, 9) DESC, transaction_date, transaction_id) AS INTEGER) AS rank, CAST(round(score, 6) AS DECIMAL(5,1)) AS score FROM sc")
def settle_ranked(spark, d):
    return scored(spark, d, ["document_id", "transaction_id", "rank", "score_1"]).withColumnRenamed("score_1", "score")


@query(f"WITH {DECIDED} SELECT document_id, status, transaction_id, round(score, 6) AS score FROM dec")
def settle_decide(spark, d):
    t = formed(spark, d)
    found = best(spark, d, t, ["document_id", "transaction_id", "transaction_date", "score", "forced"])
    return settlement.decide(t, found).select("document_id", "status", "transaction_id", F.round("score", 6).alias("score"))


@query(f"""WITH {DECIDED}, held AS (SELECT s.transaction_id, s.document_id, s.document_id IN (SELECT document_id FROM dec) AS now FROM {{settlements}} s WHERE s.status IN (1, 2)),
  free AS (SELECT * FROM dec WHERE status = 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.transaction_id = dec.transaction_id AND (NOT h.now OR h.document_id > dec.document_id))),
  keep AS (SELECT min(document_id) AS document_id FROM free GROUP BY transaction_id),
  fin AS (SELECT document_id, CASE WHEN status = 1 AND document_id NOT IN (SELECT document_id FROM keep) THEN 3 ELSE status END AS status, transaction_id FROM dec)
SELECT f.document_id, f.status, f.transaction_id, NOT (f.status IS NOT DISTINCT FROM s.status AND f.transaction_id IS NOT DISTINCT FROM s.transaction_id) AS changed FROM fin f LEFT JOIN {{settlements}} s USING (document_id)""")
def settle_claim(spark, d):
    t = formed(spark, d)
    out, _ = settlement.settle(t, txs(spark, d), None, partner_forms(spark, d), model(spark, d, "settlements"))
    return out.select("document_id", "status", "transaction_id", "changed")


@query(f"WITH {TX}, {LIMITS} SELECT transaction_id, CAST(len AS INTEGER) AS len, CAST(mx AS INTEGER) AS batch_max, at_limit FROM cut")
def ambiguity_at_limit(spark, d):
    return settlement.at_limit(txs(spark, d)).select("transaction_id", "len", "batch_max", "at_limit")


@query(f"WITH {TX}, {LIMITS} SELECT transaction_id, n_names FROM amb")
def ambiguity_prefix(spark, d):
    return settlement.ambiguous(txs(spark, d), partner_forms(spark, d)).select("transaction_id", "n_names")


@query("""SELECT u AS upper, l AS lower, round(CASE WHEN c >= f THEN greatest(least(80, c), f) END, 6) AS cap FROM (
  SELECT u, l, (u - 60 - 1) / 0.4 AS c, (l - 32) / 0.4 AS f FROM (SELECT CAST(50 + n_nationkey * 2 AS DOUBLE) AS u, CAST(30 + n_regionkey * 10 AS DOUBLE) AS l FROM {nation}))""")
def cap_for(spark, d):
    n = model(spark, d, "nation").select((50 + F.col("n_nationkey") * 2).cast("double").alias("upper"), (30 + F.col("n_regionkey") * 10).cast("double").alias("lower"))
    return n.withColumn("cap", F.round(values.name_cap(F.col("upper"), F.col("lower")), 6))


@query(f"WITH p AS (SELECT partner_id, partner_id % 4 AS client_id, {norm('core')} AS norm FROM {{partners}}) SELECT a.partner_id FROM p a WHERE a.norm <> '' AND EXISTS (SELECT 1 FROM p b WHERE b.client_id = a.client_id AND starts_with(b.norm, a.norm) AND length(b.norm) > length(a.norm))")
def risky_prefix_self_join(spark, d):
    p = model(spark, d, "partners").select("partner_id", (F.col("partner_id") % 4).alias("client_id"), text.normalize(F.col("core")).alias("norm"))
    return settlement.risky_prefixes(p).select("partner_id")


BODY = "concat_ws(chr(31), CAST(organization_id AS VARCHAR), coalesce(CAST(actor_id AS VARCHAR), ''), target_table, CAST(target_id AS VARCHAR), action, coalesce(before, ''), coalesce(after, ''), coalesce(CAST(threshold_id AS VARCHAR), ''), strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f'))"


@query(f"SELECT id, sha256(prev || chr(31) || {BODY}) AS row_hash FROM (SELECT *, sha256(CAST(id - 1 AS VARCHAR)) AS prev FROM {{audit}})")
def audit_payload_hash(spark, d):
    return model(spark, d, "audit").select("id", audit.row_hash(F.sha2((F.col("id") - 1).cast("string"), 256)).alias("row_hash"))


LOG = f"SELECT *, CASE WHEN id % 50 = 0 THEN 'edited' ELSE sha256(CAST(id AS STRING)) END AS row_hash FROM (SELECT *, CASE WHEN id % 77 = 0 THEN 'cut' ELSE sha256(CAST(id - 1 AS STRING)) END AS prev_hash, CASE WHEN id % 90 = 0 THEN 2 ELSE 1 END AS hash_version FROM {{audit}} WHERE id % 101 <> 0)"


@query(f"""WITH l AS ({LOG.replace("{audit}", "{audit}")}), c AS (SELECT *, lag(row_hash) OVER (ORDER BY id) AS expect, row_number() OVER (ORDER BY id) AS rn FROM l)
SELECT id AS bad_id, CASE WHEN rn > 1 AND prev_hash IS DISTINCT FROM expect THEN 'link broken' ELSE 'content does not match hash' END AS reason FROM c
WHERE (rn > 1 AND prev_hash IS DISTINCT FROM expect) OR (hash_version = 2 AND row_hash IS DISTINCT FROM sha256(coalesce(prev_hash, '') || chr(31) || {BODY}))""")
def audit_verify(spark, d):
    log = spark.sql(LOG.replace("sha256(CAST(id AS STRING))", "sha2(CAST(id AS STRING), 256)").replace("sha256(CAST(id - 1 AS STRING))", "sha2(CAST(id - 1 AS STRING), 256)"), audit=model(spark, d, "audit"))
    return audit.verify(log)


@query(f"SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, list_reduce(list_prepend('', list({BODY} ORDER BY id)), lambda h, b: sha256(h || chr(31) || b)) AS last_hash FROM {{audit}}")
def audit_chain(spark, d):
    log = staged(audit.chain(model(spark, d, "audit")), "log")
    bad = audit.verify(log).agg(F.count("*").alias("n_bad"))
    return log.agg(F.count("*").alias("n_rows")).crossJoin(bad).crossJoin(audit.last_hash(log).withColumnRenamed("row_hash", "last_hash"))  # one row each


@query("SELECT id, action, has_more FROM (SELECT id, action, count(*) OVER () > 50 AS has_more, row_number() OVER (ORDER BY id DESC) AS rn FROM (SELECT * FROM {audit} WHERE id < 800 AND occurred_at >= TIMESTAMP '2024-01-02' AND occurred_at < TIMESTAMP '2024-01-29' ORDER BY id DESC LIMIT 51)) WHERE rn <= 50")
def audit_keyset_page(spark, d):
    return audit.page(model(spark, d, "audit"), cursor=800, since="2024-01-02", until="2024-01-28").select("id", "action", "has_more")


@query("SELECT DISTINCT action FROM {audit}")
def audit_actions(spark, d):
    return audit.actions(model(spark, d, "audit"))


@query("SELECT sha256(CAST(max(id) AS VARCHAR)) AS row_hash FROM {audit}")
def audit_last_hash(spark, d):
    return audit.last_hash(model(spark, d, "audit").select("id", F.sha2(F.col("id").cast("string"), 256).alias("row_hash")))

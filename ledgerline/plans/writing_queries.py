"""Writes, reasons, verdicts and states that other queries don't cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import audit, decision, evaluate, mutations, reads, settlement, states
from ..operators.staging import passes
from .model import model
from .reading_queries import NOW, now
from .registry import query
from .settling_queries import DECIDED, formed, partner_forms, txs


def _read_again(spark, d):
    """(tables, new): two documents in three are read and matched anew."""
    fields, results, scores = model(spark, d, "fields"), model(spark, d, "results"), model(spark, d, "scores")
    checks = model(spark, d, "reg_checks").withColumns({"why": F.lit("old"), "looked_up_at": F.lit(1)})
    tables = {"fields": fields.select("document_id", "field_key", "value"), "candidates": scores.select("document_id", "partner_id", "rank"), "results": results.select("document_id", "decision", "decided_by"), "reg_checks": checks, "documents": model(spark, d, "docs").select("document_id", F.lit(1).alias("status"))}
    ids = tables["documents"].where("document_id % 3 > 0").select("document_id")
    k = F.col("document_id")
    new = {
        "fields": ids.select("document_id", F.lit("total").alias("field_key"), F.lit("7").alias("value")), "candidates": ids.select("document_id", (k % 9).alias("partner_id"), F.lit(1).alias("rank")),
        "results": ids.select("document_id", F.when(k % 2 == 0, 1).otherwise(5).alias("decision"), F.lit(None).cast("long").alias("decided_by")),
        "reg_checks": ids.select("document_id", F.lit("T1").alias("reg_no"), (k % 3 - 1).cast("int").alias("status"), F.lit("new").alias("why")),
    }
    return mutations.save_result(tables, new)


@query("""SELECT d.document_id, CASE WHEN d.document_id % 3 > 0 THEN 1 ELSE f.n END AS n_fields, CASE WHEN d.document_id % 3 > 0 AND r.decided_by IS NULL THEN 1 ELSE s.n END AS n_candidates,
  CASE WHEN d.document_id % 3 > 0 AND r.decided_by IS NULL THEN CASE WHEN d.document_id % 2 = 0 THEN 1 ELSE 5 END ELSE r.decision END AS decision,
  CASE WHEN d.document_id % 3 > 0 AND r.decided_by IS NULL THEN CASE WHEN d.document_id % 2 = 0 THEN 5 ELSE 4 END ELSE 1 END AS status,
  CASE WHEN d.document_id % 3 = 2 THEN 'new' ELSE 'old' END AS why, 1 AS looked_up_at
FROM {docs} d JOIN {results} r USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM {fields} GROUP BY 1) f USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS n FROM {scores} GROUP BY 1) s USING (document_id)""")
def save_result(spark, d):
    t = _read_again(spark, d)
    n = lambda name, c: t[name].groupBy("document_id").agg(F.count("*").alias(c))
    out = t["documents"].join(t["results"].select("document_id", "decision"), "document_id").join(n("fields", "n_fields"), "document_id", "left").join(n("candidates", "n_candidates"), "document_id", "left")
    return out.join(t["reg_checks"].select("document_id", "why", "looked_up_at"), "document_id", "left").select("document_id", "n_fields", "n_candidates", "decision", "status", "why", "looked_up_at")


@query("SELECT document_id, CASE WHEN status NOT IN (2, 5) AND document_id % 2 = 0 THEN 3 ELSE status END AS status, CASE WHEN status NOT IN (2, 5) AND document_id % 2 = 0 THEN -1 ELSE transaction_id END AS candidate FROM {settlements}")
def save_settlements(spark, d):
    old = model(spark, d, "settlements")
    kept = old.select("document_id", F.col("transaction_id").alias("candidate"))
    new = old.where("document_id % 2 = 0").withColumn("status", F.lit(3))
    after, candidates = mutations.save_settlements(old, kept, new, new.select("document_id", F.lit(-1).cast("long").alias("candidate")))
    return after.join(candidates, "document_id").select("document_id", "status", "candidate")


@query("SELECT document_id, status, CASE WHEN document_id % 4 = 0 THEN 'new' ELSE 'old' END AS why FROM {settlements}")
def refresh_reasons(spark, d):
    s = model(spark, d, "settlements").withColumn("why", F.lit("old"))
    return mutations.refresh_reasons(s, s.where("document_id % 4 = 0").select("document_id", F.lit("new").alias("why"))).select("document_id", "status", "why")


@query("SELECT partner_id, 'x' AS alias FROM {partners} WHERE client_id > 20")
def seed_masters(spark, d):
    p = model(spark, d, "partners")
    _, aliases = mutations.seed_masters(p.where("client_id <= 20"), p.select("client_id", "partner_id", F.col("name").alias("canonical"), F.array("name", F.lit("x")).alias("variants")))
    return aliases.select("partner_id", "alias")


@query("SELECT s.transaction_id, s.partner_id, t.amount FROM (SELECT document_id, document_id + rank - 1 AS transaction_id, partner_id, rank FROM {scores}) s JOIN {transactions} t USING (transaction_id) WHERE s.document_id = (SELECT min(document_id) FROM {scores})")
def settlement_candidates(spark, d):
    s = model(spark, d, "scores")
    one = s.agg(F.min("document_id")).first()[0]
    found = s.select("document_id", (F.col("document_id") + F.col("rank") - 1).alias("transaction_id"), "partner_id", "rank")
    return reads.settlement_candidates(found, model(spark, d, "transactions").drop("document_id", "client_id"), one).select("transaction_id", "partner_id", "amount")


@query("SELECT threshold_id, valid_from FROM {thresholds} ORDER BY valid_from DESC, threshold_id DESC LIMIT 50")
def threshold_history(spark, d):
    return reads.threshold_history(model(spark, d, "thresholds")).select("threshold_id", "valid_from")


@query("SELECT sha256(CAST(client_id AS VARCHAR)) AS key_hash, organization_id FROM {clients} WHERE client_id % 4 <> 0 AND client_id % 3 <> 0")
def organization_of_key(spark, d):
    k = F.sha2(F.col("client_id").cast("string"), 256).alias("key_hash")
    c = model(spark, d, "clients")
    keys = c.select(k, "organization_id", F.when(F.col("client_id") % 4 == 0, now()).alias("revoked_at"))
    return reads.organization_of_key(keys, c.where("client_id % 3 != 0").select(k))


@query("SELECT count(*) AS total, count(*) FILTER (status = 3) AS filtered FROM {settlements}")
def filtered_totals(spark, d):
    return reads.totals_under(model(spark, d, "settlements"), F.col("status") == 3)


LOG = "SELECT *, sha256(CAST(id AS STRING)) AS row_hash, CASE WHEN id % 7 = 0 THEN 'cut' ELSE sha256(CAST(id - 1 AS STRING)) END AS prev_hash, 1 AS hash_version FROM {audit}"


@query("SELECT id AS bad_id, 'link broken' AS reason FROM {audit} WHERE id % 7 = 0 AND id BETWEEN 100 AND 400")
def audit_verify_range(spark, d):
    log = spark.sql(LOG.replace("sha256(CAST(id AS STRING))", "sha2(CAST(id AS STRING), 256)").replace("sha256(CAST(id - 1 AS STRING))", "sha2(CAST(id - 1 AS STRING), 256)"), audit=model(spark, d, "audit"))
    return audit.verify(log, 100, 400)


@query("SELECT id FROM {audit} WHERE action = 'view' AND actor_id IS NOT NULL AND target_table = 'documents' AND actor_id = target_id ORDER BY id DESC LIMIT 50".replace("action = 'view'", "action = (SELECT min(action) FROM {audit})").replace("actor_id = target_id", "actor_id = (SELECT min(actor_id) FROM {audit} WHERE action = (SELECT min(action) FROM {audit}))"))
def audit_filters(spark, d):
    log = model(spark, d, "audit")
    first = log.agg(F.min("action")).first()[0]
    actor = log.where(F.col("action") == first).agg(F.min("actor_id")).first()[0]
    return audit.page(log, action=first, actor_id=actor, target_table="documents").select("id")


SUMMARY = "CASE id % 7 WHEN 0 THEN 'auto_approve' WHEN 1 THEN 'approve' WHEN 2 THEN 'correct' WHEN 3 THEN 'reject' WHEN 4 THEN 'needs_review' WHEN 5 THEN 'forget_alias' ELSE 'other' END"


@query("SELECT id, CASE id % 7 WHEN 0 THEN 'approved automatically' WHEN 1 THEN 'approved' WHEN 2 THEN 'corrected: none to p' || CAST(target_id AS VARCHAR) WHEN 3 THEN 'rejected' WHEN 4 THEN 'sent to review' WHEN 5 THEN 'alias forgotten' ELSE 'other' END AS line FROM {audit}")
def audit_summary(spark, d):
    log = model(spark, d, "audit").withColumns({"action": F.expr(SUMMARY), "before": F.lit("{}"), "after": F.to_json(F.struct(F.concat(F.lit("p"), F.col("target_id").cast("string")).alias("partner")))})
    return log.select("id", audit.summary().alias("line"))


ONE = lambda c: f"printf('%.1f', round({c}, 1))"


@query(f"SELECT document_id, CASE WHEN document_id % 23 = 0 THEN 'no name could be read, so nothing was matched' WHEN score IS NULL THEN 'no candidate was found' WHEN score >= 95 THEN 'score ' || {ONE('score')} || ' is at least 95.0' WHEN score >= 55 THEN 'score ' || {ONE('score')} || ' lies between 55.0 and 95.0' ELSE 'score ' || {ONE('score')} || ' is below 55.0' END AS why, CASE WHEN document_id % 23 = 0 THEN 2 WHEN score IS NULL THEN 3 WHEN score >= 95 THEN 1 WHEN score >= 55 THEN 2 ELSE 3 END AS decision FROM {{docs}} LEFT JOIN (SELECT document_id, score FROM {{scores}} WHERE rank = 1) USING (document_id)")
def decide_reasons(spark, d):
    best = model(spark, d, "docs").select("document_id", (F.col("document_id") % 23 != 0).alias("named")).join(model(spark, d, "scores").where("rank = 1").select("document_id", "partner_id", "score"), "document_id", "left")
    done = decision.decisions(best)
    return done.select("document_id", values.decide_why(F.col("decision"), F.col("score"), F.lit(95.0), F.lit(55.0), F.col("named")).alias("why"), "decision")


@query("""SELECT document_id, CASE document_id % 4 WHEN 0 THEN 'no registration number could be read: there is none, or reading failed' WHEN 1 THEN 'a registration number begins with T' WHEN 2 THEN 'T is followed by 13 digits; ' || CAST(1 + document_id % 12 AS VARCHAR) || ' were read'
  ELSE CASE WHEN document_id % 8 = 3 THEN 'well-formed; whether it exists is for the public register to say' ELSE 'the check digit of a corporate number doesn''t fit: misread, or the number of a sole proprietor' END END AS why FROM {docs}""")
def reg_reasons(spark, d):
    k = F.col("document_id")
    # 7000012050002 has the right check digit, 8000012050002 hasn't.
    raw = F.when(k % 4 == 0, F.lit(" ")).when(k % 4 == 1, F.lit("1234567890123")).when(k % 4 == 2, F.concat(F.lit("T"), F.repeat(F.lit("1"), (1 + k % 12).cast("int")))).otherwise(F.when(k % 8 == 3, F.lit("T7000012050002")).otherwise(F.lit("Ｔ8000012050002")))
    return model(spark, d, "docs").select("document_id", raw.alias("raw")).select("document_id", values.reg_why(values.reg_status(F.col("raw")), F.col("raw")).alias("why"))


@query(f"""WITH {DECIDED}, top AS (SELECT document_id, max(score) AS best FROM sc GROUP BY 1),
  facts AS (SELECT d.document_id, d.status, top.best, sc.name_score, sc.amount_score, sc.date_score, b.total - b.amount AS diff, b.issue_date IS NULL AS undated, b.source_type = 1 AND b.transaction_date < b.issue_date AS early, a.n_names
    FROM dec d LEFT JOIN top USING (document_id) LEFT JOIN sc ON sc.document_id = d.document_id AND sc.transaction_id = d.transaction_id LEFT JOIN band b ON b.document_id = d.document_id AND b.transaction_id = d.transaction_id LEFT JOIN amb a ON a.transaction_id = d.transaction_id)
SELECT document_id, CASE WHEN best IS NULL THEN 'none' WHEN status = 4 THEN 'low' ELSE CASE status WHEN 1 THEN 'auto' ELSE 'review' END END AS kind, status < 4 AND diff > 0 AS fee, status < 4 AND undated AS undated, status < 4 AND coalesce(early, false) AS early, status = 3 AND n_names IS NOT NULL AS ambiguous FROM facts""")
def settle_reasons(spark, d):
    """What the reason of each settlement tells."""
    found = settlement.best_of_all(formed(spark, d), txs(spark, d), None, partner_forms(spark, d), n=passes(model(spark, d, "docs")))
    # What is told here doesn't depend on the list of names.
    why = settlement.told(found.withColumn("names", F.lit("")))
    kind = F.when(F.col("why").startswith("no transaction"), "none").when(F.col("why").startswith("the best score"), "low").when(F.col("why").contains("is at least"), "auto").otherwise("review")
    told = {"fee": "transfer fee", "undated": "date is unreadable", "early": "perhaps in advance", "ambiguous": "description is cut off and fits"}
    return why.select("document_id", kind.alias("kind"), *(F.col("why").contains(x).alias(c) for c, x in told.items()))


VERDICT = f"""SELECT subscription_id, CASE WHEN exempt THEN 'exempt from billing' WHEN status IN ('active', 'trialing') THEN CASE WHEN subscription_id % 2 = 0 THEN 'ends on 2024-02-01' ELSE '' END WHEN status IN ('past_due', 'unpaid') THEN CASE WHEN grace_until > {NOW} THEN 'payment is missing; everything works until ' || strftime(grace_until, '%Y-%m-%d') ELSE 'payment is missing and the grace period is over' END
  WHEN status = 'canceled' THEN 'the subscription has ended' WHEN status IN ('incomplete', 'incomplete_expired') THEN 'the application wasn''t finished' WHEN status = 'paused' THEN 'the subscription is paused' WHEN status IS NULL THEN 'no subscription' ELSE 'unknown state of subscription: ' || status END AS reason,
  CASE WHEN exempt THEN '' WHEN status IN ('active', 'trialing') THEN CASE WHEN subscription_id % 2 = 0 THEN 'take back the cancellation to go on' ELSE '' END WHEN status IN ('past_due', 'unpaid') THEN 'check the means of payment' WHEN status = 'canceled' THEN 'subscribe again to go on' WHEN status IN ('incomplete', 'incomplete_expired') THEN 'start the application again' WHEN status = 'paused' THEN 'resume the subscription' WHEN status IS NULL THEN 'subscribe' ELSE 'nothing to do; the state is being looked into' END AS next_step,
  NOT exempt AND coalesce(status IN ('past_due', 'unpaid') AND grace_until > {NOW}, false) AS in_grace FROM (SELECT s.*, coalesce(o.billing_exempt, false) AS exempt FROM {{subscriptions}} s LEFT JOIN {{organizations}} o USING (organization_id))"""


@query(VERDICT)
def billing_verdict(spark, d):
    both = model(spark, d, "subscriptions").join(model(spark, d, "organizations").select("organization_id", "billing_exempt"), "organization_id", "left")
    v = values.billing_verdict(F.coalesce("billing_exempt", F.lit(False)), F.col("status"), F.col("grace_until"), F.col("subscription_id") % 2 == 0, F.to_date(F.lit("2024-02-01")), now())
    return both.select("subscription_id", v.alias("v")).select("subscription_id", "v.reason", "v.next_step", "v.in_grace")


@query("SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 14 DAYS AS grace_until FROM {events}")
def grace_ends(spark, d):
    return model(spark, d, "events").select("event_id", values.grace_end(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("grace_until"))


@query("SELECT document_id, CASE WHEN decided_by IS NOT NULL AND decision = 4 THEN 9 WHEN decided_by IS NOT NULL OR decision = 1 THEN 5 ELSE 4 END AS status FROM {results}")
def document_statuses(spark, d):
    return model(spark, d, "results").select("document_id", values.document_status(F.col("decision"), F.col("decided_by").isNotNull()).alias("status"))


def _jobs(spark, d):
    k = F.col("job_id")
    return model(spark, d, "jobs").withColumns({"max_attempts": F.lit(3), "locked_by": F.when(F.col("status") == 2, F.concat(F.lit("w"), (k % 2).cast("string"))), "locked_until": F.col("run_after") + F.expr("INTERVAL 30 SECONDS"), "last_error": F.lit(None).cast("string")})


@query(f"WITH j AS (SELECT *, run_after + INTERVAL 30 SECONDS AS locked_until FROM {{jobs}}), c AS (SELECT job_id FROM j WHERE run_after <= {NOW} AND (status = 1 OR (status = 2 AND locked_until < {NOW} AND attempts < 3)) ORDER BY run_after, job_id LIMIT 25) SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM c) THEN 2 ELSE status END AS status, attempts + CAST(job_id IN (SELECT job_id FROM c) AS INT) AS attempts, job_id IN (SELECT job_id FROM c) AS mine FROM j")
def queue_claim_update(spark, d):
    return states.claim(_jobs(spark, d), now(), "me", 25).select("job_id", "status", "attempts", F.coalesce(F.col("locked_by") == "me", F.lit(False)).alias("mine"))


@query(f"SELECT job_id, CASE WHEN status = 2 AND job_id % 2 = 1 THEN {NOW} + INTERVAL 30 SECONDS ELSE run_after + INTERVAL 30 SECONDS END AS locked_until FROM {{jobs}}")
def queue_heartbeat(spark, d):
    return states.touch(_jobs(spark, d), "w1", now()).select("job_id", F.col("locked_until").cast("timestamp_ntz").alias("locked_until"))


@query(f"""SELECT job_id, CASE WHEN mine THEN CASE WHEN job_id % 3 = 0 THEN 3 WHEN attempts < 3 THEN 1 ELSE 4 END ELSE status END AS status, CASE WHEN mine AND job_id % 3 > 0 AND attempts < 3 THEN {NOW} + to_seconds(attempts * attempts * 10) ELSE run_after END AS run_after, CASE WHEN mine AND job_id % 3 > 0 THEN 'broke' END AS last_error
FROM (SELECT *, status = 2 AND job_id % 2 = 1 AND job_id % 5 < 4 AS mine FROM {{jobs}})""")
def queue_finish(spark, d):
    """Worker w1 reports on four jobs in five; only those it holds change."""
    jobs = _jobs(spark, d)
    reports = jobs.where("job_id % 5 < 4").select("job_id", F.lit("w1").alias("worker"), (F.col("job_id") % 3 == 0).alias("ok"), F.lit("broke").alias("error"))
    return states.finish(jobs, reports, now()).select("job_id", "status", F.col("run_after").cast("timestamp_ntz").alias("run_after"), "last_error")


@query("SELECT preset, document_id, lower(CAST(document_id % 2 = 0 AS VARCHAR)) AS hit FROM (SELECT CASE CAST(document_id % 3 AS INT) WHEN 0 THEN 'light' WHEN 1 THEN 'normal' ELSE 'heavy' END AS preset, document_id FROM {docs})".replace("document_id, lower", "CAST(document_id AS VARCHAR) AS document_id, lower"))
def evaluation_sheets(spark, d):
    k = F.col("document_id")
    preset = F.when(k % 3 == 0, "light").when(k % 3 == 1, "normal").otherwise("heavy")
    return evaluate.per_sheet(model(spark, d, "docs").select(preset.alias("preset"), "document_id", (k % 2 == 0).alias("hit")))

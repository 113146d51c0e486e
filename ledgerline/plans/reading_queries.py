"""Read queries of screens and endpoints, and what writes leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import mutations, reads, states
from .model import model
from .registry import query

NOW = "TIMESTAMP '2024-01-15 00:00:00'"


def now():
    return F.to_timestamp(F.lit("2024-01-15 00:00:00"))



def _impact(spark, d):
    s = model(spark, d, "scores").withColumn("score_detail", F.to_json(F.struct("matched")))
    return reads.impact(model(spark, d, "results"), s)


@query("SELECT document_id FROM {docs} d JOIN {clients} c USING (client_id) WHERE organization_id = 2")
def tenant_scope(spark, d):
    return reads.scoped(model(spark, d, "docs"), model(spark, d, "clients"), 2).select("document_id")


@query("SELECT partner_id, count(*) AS total, count(*) FILTER (decision = 1) AS auto, count(*) FILTER (decision = 5) AS review, count(*) FILTER (decision = 4) AS reject, count(decided_by) AS by_human, min(decided_at) AS first_at, max(decided_at) AS last_at FROM {results} GROUP BY partner_id")
def impact_by_partner(spark, d):
    rows = _impact(spark, d)
    c = F.col("decision")
    return rows.groupBy("partner_id").agg(F.count("*").alias("total"), F.count_if(c == 1).alias("auto"), F.count_if(c == 5).alias("review"), F.count_if(c == 4).alias("reject"), F.count("decided_by").alias("by_human"), F.min("decided_at").alias("first_at"), F.max("decided_at").alias("last_at"))


@query("SELECT count(*) AS total, count(*) FILTER (decision = 1) AS auto, count(*) FILTER (decision = 5) AS review, count(*) FILTER (decision = 4) AS reject, count(decided_by) AS by_human, min(decided_at) AS first_at, max(decided_at) AS last_at FROM {results} r LEFT JOIN {scores} s ON s.document_id = r.document_id AND s.rank = 1 WHERE s.score >= 70")
def impact_by_threshold(spark, d):
    return reads.impact_summary(_impact(spark, d).where("best_score >= 70"))


@query("SELECT r.document_id, s.score AS best_score FROM {results} r LEFT JOIN {scores} s ON s.document_id = r.document_id AND s.rank = 1 WHERE s.matched = 'form7'")
def impact_by_json_form(spark, d):
    return _impact(spark, d).where("matched = 'form7'").select("document_id", "best_score")


@query("SELECT document_id, decision, decided_at FROM {results} WHERE partner_id < 60 ORDER BY decision = 1 DESC, decided_at DESC, document_id LIMIT 200")
def impact_list(spark, d):
    return reads.impact_list(_impact(spark, d).where("partner_id < 60")).select("document_id", "decision", "decided_at")


@query("SELECT status, count(*) AS n FROM {settlements} GROUP BY status")
def status_counts(spark, d):
    return reads.status_counts(model(spark, d, "settlements"))


@query("SELECT document_id, status FROM {reg_checks} WHERE status IN (1, 2, 3, 6)")
def status_attention(spark, d):
    return reads.by_status(model(spark, d, "reg_checks"), "registration", "attention").select("document_id", "status")


@query("SELECT document_id, CASE WHEN direction = 2 THEN 'recipient_name' ELSE 'issuer_name' END AS field_key, f.value AS party FROM {docs} d LEFT JOIN {fields} f USING (document_id) WHERE f.field_key = CASE WHEN d.direction = 2 THEN 'recipient_name' ELSE 'issuer_name' END")
def party_names(spark, d):
    named = reads.party_names(model(spark, d, "docs"), model(spark, d, "fields"))
    return named.join(model(spark, d, "docs").select("document_id", values.name_field(F.col("direction")).alias("field_key")), "document_id").select("document_id", "field_key", "party")


@query("SELECT reg_no, count(DISTINCT party) AS n_names, count(*) AS n_documents, string_agg(DISTINCT party, ' / ' ORDER BY party) AS names FROM {reg_checks} r JOIN (SELECT d.document_id, f.value AS party FROM {docs} d JOIN {fields} f USING (document_id) WHERE f.field_key = CASE WHEN d.direction = 2 THEN 'recipient_name' ELSE 'issuer_name' END) USING (document_id) WHERE reg_no IS NOT NULL GROUP BY reg_no HAVING count(DISTINCT party) > 1")
def reg_conflicts(spark, d):
    return reads.registration_conflicts(model(spark, d, "reg_checks"), reads.party_names(model(spark, d, "docs"), model(spark, d, "fields")))


@query("SELECT r.document_id, r.reg_no, r.status, f.value AS party FROM (SELECT * FROM {reg_checks} ORDER BY document_id DESC LIMIT 200) r JOIN {docs} d USING (document_id) LEFT JOIN {fields} f ON f.document_id = r.document_id AND f.field_key = CASE WHEN d.direction = 2 THEN 'recipient_name' ELSE 'issuer_name' END")
def registration_list(spark, d):
    return reads.registration_list(model(spark, d, "reg_checks"), model(spark, d, "docs"), model(spark, d, "fields")).select("document_id", "reg_no", "status", "party")


@query("SELECT reg_no, CASE WHEN reg_no LIKE '%5' OR reg_no LIKE '%7' THEN 6 ELSE 5 END AS status FROM (SELECT DISTINCT reg_no FROM {reg_checks} WHERE reg_no IS NOT NULL)")
def lookup_apply(spark, d):
    numbers = model(spark, d, "reg_checks").where("reg_no IS NOT NULL").select("reg_no").distinct()
    register = numbers.where("reg_no NOT LIKE '%5'").select("reg_no", F.lit(True).alias("found"), F.col("reg_no").endswith("7").alias("revoked"))
    return numbers.join(register, "reg_no", "left").select("reg_no", values.reg_lookup(F.col("found"), F.col("revoked")).alias("status"))


@query("SELECT count(*) AS n FROM {docs} d WHERE direction = 1 AND NOT EXISTS (SELECT 1 FROM {settlements} s WHERE s.document_id = d.document_id)")
def unsettled_anti(spark, d):
    return reads.unsettled(model(spark, d, "docs"), model(spark, d, "settlements"))


@query("SELECT s.document_id, s.transaction_id FROM {settlements} s WHERE EXISTS (SELECT 1 FROM {settlements} o WHERE o.transaction_id = s.transaction_id AND o.document_id <> s.document_id AND o.status IN (1, 2))")
def claimed_elsewhere(spark, d):
    return reads.claimed_elsewhere(model(spark, d, "settlements"))


@query(f"SELECT c.c_custkey AS document_id, j.job_id, j.status AS job_status, CASE WHEN j.status = 1 THEN greatest(0, epoch_ms({NOW}) - epoch_ms(j.run_after)) END AS waiting_ms FROM {{customer}} c LEFT JOIN (SELECT * FROM {{jobs}} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY job_id DESC) = 1) j ON j.document_id = c.c_custkey")
def latest_job_lateral(spark, d):
    docs = model(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    return reads.latest_job(docs, model(spark, d, "jobs"), now()).select("document_id", "job_id", "job_status", "waiting_ms")


@query("SELECT o.organization_id, s.subscription_id, s.status FROM {organizations} o LEFT JOIN (SELECT * FROM {subscriptions} WHERE status NOT IN ('canceled', 'incomplete_expired') QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY subscription_id DESC) = 1) s USING (organization_id)")
def latest_subscription(spark, d):
    return reads.latest_subscription(model(spark, d, "organizations"), model(spark, d, "subscriptions")).select("organization_id", "subscription_id", "status")


@query("SELECT c.customer_id, coalesce(o.organization_id, s.organization_id) AS organization_id FROM (SELECT DISTINCT customer_id FROM {subscriptions}) c LEFT JOIN {organizations} o ON o.stripe_customer_id = c.customer_id LEFT JOIN (SELECT customer_id, max_by(organization_id, subscription_id) AS organization_id FROM {subscriptions} GROUP BY customer_id) s ON s.customer_id = c.customer_id")
def organization_of_customer(spark, d):
    s = model(spark, d, "subscriptions")
    return reads.organization_of_customer(s.select("customer_id").distinct(), model(spark, d, "organizations"), s)


@query("SELECT document_id, decision, score AS best_score FROM {results} r LEFT JOIN (SELECT document_id, score FROM {scores} WHERE rank = 1) USING (document_id) WHERE decision = 5 ORDER BY score DESC NULLS LAST, document_id LIMIT 50")
def review_queue(spark, d):
    return reads.review_queue(model(spark, d, "results"), model(spark, d, "scores")).select("document_id", "decision", "best_score")


@query("""SELECT document_id, (SELECT string_agg(field_key || '=' || value, ';' ORDER BY field_key, value) FROM {fields} f WHERE f.document_id = d.document_id) AS fields, p.name AS partner_name,
  (SELECT string_agg(CAST(rank AS VARCHAR) || ':' || CAST(s.partner_id AS VARCHAR), ';' ORDER BY rank) FROM {scores} s WHERE s.document_id = d.document_id) AS candidates
FROM {docs} d LEFT JOIN {results} r USING (document_id) LEFT JOIN {partners} p ON p.partner_id = r.partner_id""")
def document_view(spark, d):
    v = reads.document_view(model(spark, d, "docs").select("document_id"), model(spark, d, "fields"), model(spark, d, "results"), model(spark, d, "partners"), model(spark, d, "scores"))
    fields = F.array_join(F.transform("fields", lambda x: F.concat(x.field_key, F.lit("="), x.value)), ";")
    cands = F.array_join(F.transform("candidates", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x.partner_id.cast("string"))), ";")
    return v.select("document_id", fields.alias("fields"), "partner_name", cands.alias("candidates"))


@query("SELECT d.document_id, c.name AS client_name, r.decision FROM (SELECT * FROM {docs} ORDER BY document_id DESC LIMIT 100) d JOIN {clients} c USING (client_id) LEFT JOIN {results} r USING (document_id)")
def document_list(spark, d):
    return reads.document_list(model(spark, d, "docs"), model(spark, d, "clients"), model(spark, d, "results")).select("document_id", "client_name", "decision")


@query("SELECT a.document_id, b.document_id AS sibling_id FROM {docs} a JOIN {docs} b ON a.client_id = b.client_id AND a.source_name = b.source_name AND a.document_id <> b.document_id")
def document_siblings(spark, d):
    return reads.siblings(model(spark, d, "docs")).select("document_id", "sibling_id")


@query("SELECT alias_id, alias, p.name AS partner_name FROM {aliases} a JOIN {partners} p USING (partner_id) WHERE source = 2 ORDER BY alias_id DESC LIMIT 100")
def learned_aliases(spark, d):
    return reads.learned_aliases(model(spark, d, "aliases"), model(spark, d, "partners")).select("alias_id", "alias", "partner_name")


@query("SELECT threshold_id, upper, lower FROM {thresholds} WHERE valid_to IS NULL")
def current_thresholds(spark, d):
    return reads.current_thresholds(model(spark, d, "thresholds")).select("threshold_id", "upper", "lower")


@query("SELECT batch_id, min(transaction_date) AS first_date, max(transaction_date) AS last_date FROM {transactions} WHERE batch_id >= 1077 GROUP BY batch_id")
def import_history(spark, d):
    t = model(spark, d, "transactions")
    return reads.import_history(t.select("batch_id").distinct(), t).select("batch_id", "first_date", "last_date")


@query("SELECT s.document_id, s.status, t.amount, t.description FROM (SELECT * FROM {settlements} ORDER BY document_id DESC LIMIT 200) s LEFT JOIN {transactions} t USING (transaction_id)")
def settlement_list(spark, d):
    return reads.settlement_list(model(spark, d, "settlements"), model(spark, d, "fields"), model(spark, d, "transactions")).select("document_id", "status", "amount", "description")


@query("SELECT count(*) AS n FROM {clients} WHERE ocr_engine = 'vision'")
def engine_clients(spark, d):
    return reads.engine_clients(model(spark, d, "clients"), "vision")


@query("SELECT (SELECT count(*) FROM {docs}) AS n_documents, (SELECT count(*) FROM {results}) AS n_results, (SELECT count(*) FROM {aliases}) AS n_aliases, (SELECT count(*) FROM {settlements}) AS n_settlements, (SELECT count(*) FROM {audit}) AS n_log")
def tenant_snapshot(spark, d):
    return reads.tenant_snapshot(*(model(spark, d, n) for n in ("docs", "results", "aliases", "settlements", "audit")))


@query("SELECT event_id, event_type FROM {events} WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-11'")
def date_inclusive_range(spark, d):
    return reads.within_days(model(spark, d, "events"), "ts", "2024-01-03", "2024-01-10").select("event_id", "event_type")


@query("SELECT document_id, CASE WHEN direction IN (1, 2) AND document_id % 4 <> 0 THEN direction ELSE default_direction END AS direction FROM {docs} JOIN {clients} USING (client_id)")
def create_documents(spark, d):
    up = model(spark, d, "docs").withColumn("direction", F.when(F.col("document_id") % 4 != 0, F.col("direction")).otherwise(0))
    return mutations.create_documents(up, model(spark, d, "clients"), now())[0].select("document_id", "direction")


@query("SELECT document_id, CASE WHEN decided_by IS NULL AND document_id % 2 = 0 THEN 4 ELSE decision END AS decision FROM {results}")
def save_results(spark, d):
    r = model(spark, d, "results")
    return mutations.save_results(r, r.where("document_id % 2 = 0").withColumns({"decision": F.lit(4), "decided_by": F.lit(None).cast("bigint")})).select("document_id", "decision")


@query("SELECT document_id, CASE WHEN document_id % 6 = 0 THEN 3 ELSE decision END AS decision, CASE WHEN document_id % 6 = 0 THEN partner_id + 1 ELSE partner_id END AS partner_id, CASE WHEN document_id % 6 = 0 THEN 'correct' END AS action FROM {results}")
def approve(spark, d):
    r = model(spark, d, "results")
    asked = r.where("document_id % 6 = 0")
    first = asked.select((F.col("document_id") * 2).alias("order_id"), "document_id", F.lit(4).alias("decision"), "partner_id", F.lit(7).cast("bigint").alias("decided_by"), "decided_at")
    last = asked.select((F.col("document_id") * 2 + 1).alias("order_id"), "document_id", F.lit(3).alias("decision"), (F.col("partner_id") + 1).alias("partner_id"), F.lit(7).cast("bigint").alias("decided_by"), "decided_at")
    return mutations.approve(r, first.unionByName(last)).select("document_id", "decision", "partner_id", "action")


@query("SELECT DISTINCT partner_id, matched AS alias FROM {scores} WHERE rank = 2 AND (partner_id, matched) NOT IN (SELECT partner_id, alias FROM {aliases})")
def learn_aliases(spark, d):
    orders = model(spark, d, "scores").where("rank = 2").select(F.lit(3).alias("decision"), "partner_id", F.col("matched").alias("alias"))
    return mutations.learn_aliases(orders, model(spark, d, "aliases")).select("partner_id", "alias")


@query("SELECT alias_id FROM {aliases} JOIN {partners} USING (partner_id) JOIN {clients} USING (client_id) WHERE NOT (source = 2 AND organization_id = 3)")
def forget_aliases(spark, d):
    a = model(spark, d, "aliases").join(model(spark, d, "partners").select("partner_id", "client_id"), "partner_id").join(model(spark, d, "clients").select("client_id", "organization_id"), "client_id")
    return mutations.forget_aliases(a, a.select("alias_id", F.lit(3).cast("bigint").alias("organization_id"))).select("alias_id")


BILLING = f"""CASE WHEN billing_exempt THEN true WHEN s.status IS NULL THEN false WHEN s.status IN ('active', 'trialing') THEN true
  WHEN s.status IN ('past_due', 'unpaid') THEN coalesce(grace_until > {NOW}, false) WHEN s.status IN ('canceled', 'incomplete', 'incomplete_expired', 'paused') THEN false ELSE true END"""


@query(f"SELECT s.subscription_id, {BILLING} AS allowed FROM {{subscriptions}} s LEFT JOIN {{organizations}} o USING (organization_id)".replace("billing_exempt", "coalesce(billing_exempt, false)"))
def billing_evaluate(spark, d):
    both = model(spark, d, "subscriptions").join(model(spark, d, "organizations").select("organization_id", "billing_exempt"), "organization_id", "left")
    return both.select("subscription_id", values.billing_allowed(F.coalesce("billing_exempt", F.lit(False)), F.col("status"), F.col("grace_until"), now()).alias("allowed"))


@query("SELECT job_id, CAST(attempts * attempts * 10 AS INTEGER) AS wait_seconds, attempts >= 3 AS gives_up FROM {jobs}")
def retry_backoff(spark, d):
    return model(spark, d, "jobs").select("job_id", values.backoff_seconds(F.col("attempts")).alias("wait_seconds"), (F.col("attempts") >= 3).alias("gives_up"))


@query(f"SELECT job_id FROM {{jobs}} WHERE run_after <= {NOW} AND (status = 1 OR (status = 2 AND run_after + INTERVAL 30 SECONDS < {NOW} AND attempts < 3)) ORDER BY run_after, job_id LIMIT 25")
def queue_claim(spark, d):
    jobs = model(spark, d, "jobs").withColumns({"locked_until": F.col("run_after") + F.expr("INTERVAL 30 SECONDS"), "max_attempts": F.lit(3)})
    return states.claimable(jobs, now(), 25).select("job_id")


@query(f"SELECT event_id FROM {{events}} WHERE abs(epoch(CAST(ts AS TIMESTAMP)) - epoch({NOW})) < 301 AND abs(epoch_ms(CAST(ts AS TIMESTAMP)) // 1000 - epoch_ms({NOW}) // 1000) <= 300")
def replay_window(spark, d):
    return states.replayable(model(spark, d, "events").withColumn("sent_at", F.col("ts").cast("timestamp")), now()).select("event_id")

"""Read queries of the screens and endpoints. Everything goes through scoped() first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import name_field
from .settlement import field_pivot

ATTENTION = {"settlement": (3, 4), "registration": (1, 2, 3, 6)}


def scoped(df: DataFrame, clients: DataFrame, organization_id) -> DataFrame:
    """Rows of the organisation's clients."""
    mine = clients.where(F.col("organization_id") == organization_id).select("client_id")
    return df.join(mine, "client_id", "left_semi")


def optional(df: DataFrame, column: str, value) -> DataFrame:
    """A predicate that None turns off."""
    return df if value is None else df.where(F.col(column) == value)


def by_status(df: DataFrame, kind: str, status: str | int = "all") -> DataFrame:
    """All rows, those that need attention, or those of one status."""
    if status == "all":
        return df
    return df.where(F.col("status").isin(*ATTENTION[kind])) if status == "attention" else df.where(F.col("status") == int(status))


def clamp(value: int | None, least: int, most: int, default: int) -> int:
    return default if value is None else max(least, min(most, value))


def within_days(df: DataFrame, column: str, since, until) -> DataFrame:
    """Timestamps from the beginning of the first day to the end of the last."""
    return df.where((F.col(column) >= F.to_timestamp(F.lit(since))) & (F.col(column) < F.to_timestamp(F.lit(until)) + F.expr("INTERVAL 1 DAY")))


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order (a lateral top-1)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_job(documents: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Each document with its newest job; a waiting one tells how long it has been due."""
    job = latest(jobs, ["document_id"], [F.col("job_id").desc()]).select("document_id", "job_id", F.col("status").alias("job_status"), "attempts", "run_after")
    out = documents.join(job, "document_id", "left")
    late = F.when(F.col("job_status") == 1, F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis("run_after")))
    return out.withColumn("waiting_ms", late).drop("run_after")


def latest_subscription(organizations: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each organisation with its newest live subscription."""
    live = subscriptions.where(~F.col("status").isin("canceled", "incomplete_expired"))
    newest = latest(live, ["organization_id"], [F.col("subscription_id").desc()])
    told = [c for c in ("subscription_id", "status", "grace_until", "cancel_at_period_end", "current_period_end") if c in newest.columns]
    return organizations.join(newest.select("organization_id", *told), "organization_id", "left")


def organization_of_customer(customers: DataFrame, organizations: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """customer_id to organization_id: the organisation that names it, else that of its newest subscription."""
    direct = organizations.select("organization_id", F.col("stripe_customer_id").alias("customer_id"))
    newest = subscriptions.groupBy("customer_id").agg(F.max_by("organization_id", "subscription_id").alias("fallback"))
    out = customers.join(direct, "customer_id", "left").join(newest, "customer_id", "left")
    return out.select("customer_id", F.coalesce("organization_id", "fallback").alias("organization_id"))


def document_view(documents: DataFrame, fields: DataFrame, results: DataFrame, partners: DataFrame, candidates: DataFrame, top: int = 5) -> DataFrame:
    """A document with its fields by key, its result and partner, and its best candidates by rank, as sorted arrays."""
    own = fields.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("field_key", "value"))).alias("fields"))
    best = candidates.where(F.col("rank") <= top).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("rank", "partner_id", "score"))).alias("candidates"))
    result = results.join(partners.select("partner_id", F.col("name").alias("partner_name")), "partner_id", "left").select("document_id", "decision", "partner_id", "partner_name")
    return documents.join(own, "document_id", "left").join(result, "document_id", "left").join(best, "document_id", "left")


def document_list(documents: DataFrame, clients: DataFrame, results: DataFrame, top: int = 100) -> DataFrame:
    newest = documents.orderBy(F.col("document_id").desc()).limit(top)
    return newest.join(clients.select("client_id", F.col("name").alias("client_name")), "client_id").join(results.select("document_id", "decision"), "document_id", "left")


def siblings(documents: DataFrame) -> DataFrame:
    """(document_id, sibling_id): other documents of the same source file, by page and region."""
    a = documents.select("document_id", "client_id", "source_name")
    b = documents.select(F.col("document_id").alias("sibling_id"), "client_id", "source_name", "source_page", "source_region")
    return a.join(b, ["client_id", "source_name"]).where(F.col("document_id") != F.col("sibling_id")).select("document_id", "sibling_id", "source_page", "source_region")


def learned_aliases(aliases: DataFrame, partners: DataFrame, top: int = 100) -> DataFrame:
    """Aliases of these partners (an organisation's) that corrections taught, newest first."""
    return aliases.where("source = 2").join(partners.select("partner_id", F.col("name").alias("partner_name")), "partner_id").orderBy(F.col("alias_id").desc()).limit(top)


def current_thresholds(history: DataFrame) -> DataFrame:
    return history.where("valid_to IS NULL")


def threshold_history(history: DataFrame, top: int = 50) -> DataFrame:
    """The newest generations."""
    return history.orderBy(F.col("valid_from").desc(), F.col("threshold_id").desc()).limit(top)


def organization_of_key(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key_hash) to the organisation of a key that isn't revoked: keys (key_hash, organization_id, revoked_at)."""
    return asked.join(keys.where("revoked_at IS NULL").select("key_hash", "organization_id"), "key_hash")


def totals_under(rows: DataFrame, condition: Column) -> DataFrame:
    """Of all rows and of those under a filter, how many there are, in one pass."""
    return rows.agg(F.count("*").alias("total"), F.count_if(condition).alias("filtered"))


def review_queue(results: DataFrame, candidates: DataFrame, decision: int = 5, top: int = 50) -> DataFrame:
    """Documents that wait for a person, the surest first, unscored last."""
    best = candidates.where("rank = 1").select("document_id", F.col("score").alias("best_score"))
    return results.where(F.col("decision") == decision).join(best, "document_id", "left").orderBy(F.col("best_score").desc_nulls_last(), "document_id").limit(top)


def impact(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Results with the score and the written form of their best candidate (in its JSON detail); rank 1 is picked before the join, so nothing fans out."""
    best = candidates.where("rank = 1").select("document_id", F.col("score").alias("best_score"), F.get_json_object("score_detail", "$.matched").alias("matched"))
    return results.join(best, "document_id", "left")


def impact_summary(rows: DataFrame) -> DataFrame:
    d = F.col("decision")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(d == 1).alias("auto"), F.count_if(d == 5).alias("review"), F.count_if(d == 4).alias("reject"), F.count_if(F.col("decided_by").isNotNull()).alias("by_human"),
        F.min("decided_at").alias("first_at"), F.max("decided_at").alias("last_at"),
    )


def impact_list(rows: DataFrame, top: int = 200) -> DataFrame:
    """Automatic approvals first, then the latest; the total is counted apart from the list."""
    return rows.orderBy((F.col("decision") == 1).desc(), F.col("decided_at").desc(), "document_id").limit(top)


def settlement_list(settlements: DataFrame, fields: DataFrame, transactions: DataFrame, top: int = 200) -> DataFrame:
    wide = field_pivot(fields, ["total", "issue_date", "issuer_name"])
    newest = settlements.orderBy(F.col("document_id").desc()).limit(top)
    return newest.join(wide, "document_id", "left").join(transactions.select("transaction_id", "transaction_date", "amount", "description"), "transaction_id", "left")


def settlement_candidates(candidates: DataFrame, transactions: DataFrame, document_id) -> DataFrame:
    return candidates.where(F.col("document_id") == document_id).join(transactions, "transaction_id").orderBy("rank")


def unsettled(documents: DataFrame, settlements: DataFrame) -> DataFrame:
    """Received documents without any settlement row."""
    return documents.where("direction = 1").join(settlements.select("document_id"), "document_id", "left_anti").agg(F.count("*").alias("n"))


def claimed_elsewhere(settlements: DataFrame) -> DataFrame:
    """Settlements whose transaction another document holds too, automatically or confirmed."""
    held = settlements.where(F.col("status").isin(1, 2) & F.col("transaction_id").isNotNull())
    count = held.groupBy("transaction_id").agg(F.count("*").alias("holders"), F.max("document_id").alias("one"))
    out = settlements.join(count, "transaction_id")
    return out.where((F.col("holders") > 1) | (F.col("one") != F.col("document_id"))).select("document_id", "transaction_id")


def import_history(batches: DataFrame, transactions: DataFrame, top: int = 20) -> DataFrame:
    dates = transactions.groupBy("batch_id").agg(F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"))
    return batches.orderBy(F.col("batch_id").desc()).limit(top).join(dates, "batch_id", "left")


def party_names(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """(document_id, party): the issuer of a received document, the recipient of an issued one."""
    keyed = documents.select("document_id", "client_id", name_field(F.col("direction")).alias("field_key"))
    return keyed.join(fields.select("document_id", "field_key", F.col("value").alias("party")), ["document_id", "field_key"], "left").select("document_id", "client_id", "party")


def registration_list(checks: DataFrame, documents: DataFrame, fields: DataFrame, top: int = 200) -> DataFrame:
    named = party_names(documents, fields).select("document_id", "party")
    return checks.join(named, "document_id", "left").orderBy(F.col("document_id").desc()).limit(top)


def registration_conflicts(checks: DataFrame, parties: DataFrame) -> DataFrame:
    """Numbers that documents give for more than one name."""
    both = checks.where("reg_no IS NOT NULL").join(parties.where("party IS NOT NULL"), "document_id")
    out = both.groupBy("reg_no").agg(F.count_distinct("party").alias("n_names"), F.count("*").alias("n_documents"), F.array_join(F.sort_array(F.collect_set("party")), " / ").alias("names"))
    return out.where("n_names > 1")


def engine_clients(clients: DataFrame, engine: str) -> DataFrame:
    return clients.where(F.col("ocr_engine") == engine).agg(F.count("*").alias("n"))


def tenant_snapshot(documents: DataFrame, results: DataFrame, aliases: DataFrame, settlements: DataFrame, log: DataFrame) -> DataFrame:
    """Five facts to hold before and after an operation that must not touch a tenant."""
    parts = [df.agg(F.count("*").alias(n)) for n, df in (("n_documents", documents), ("n_results", results), ("n_aliases", aliases), ("n_settlements", settlements), ("n_log", log))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out

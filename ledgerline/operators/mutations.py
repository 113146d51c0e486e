"""Writes as DataFrames: what a table is after them. The caller writes the outcome in one go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import decision_action, document_status, grace_end


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old lacks, once for each key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def create_documents(uploads: DataFrame, clients: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) of uploads (document_id, client_id, direction, source_name, ..); a direction that is neither
    received nor issued falls back to the client's default; uploads of unknown clients yield nothing."""
    known = uploads.join(clients.select("client_id", "default_direction"), "client_id")
    direction = F.coalesce(F.when(F.col("direction").isin(1, 2), F.col("direction")), F.col("default_direction"))
    docs = known.withColumns({"direction": direction, "status": F.lit(1), "uploaded_at": now}).drop("default_direction")
    jobs = docs.select("document_id", F.lit(1).alias("status"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), now.alias("run_after"))
    return docs, jobs


def save_results(results: DataFrame, new: DataFrame) -> DataFrame:
    """New results replace old ones, but never a person's decision."""
    human = results.where("decided_by IS NOT NULL").select("document_id")
    return upsert(results, new.join(human, "document_id", "left_anti"), ["document_id"])


def save_result(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after documents were read and matched anew, to be written together.

    new and tables hold fields, candidates, results and reg_checks; tables also documents. A document of new["results"]
    loses its former fields and candidates and gets the new ones; its registration check is replaced, unless there is
    none, but what the register said of it (looked_up_at and all after) stays; its status follows the result. Documents
    that a person decided keep result, candidates and status.
    """
    done = new["results"].select("document_id")
    human = tables["results"].where("decided_by IS NOT NULL").select("document_id")
    free = done.join(human, "document_id", "left_anti")

    def swap(name: str, mine: DataFrame) -> DataFrame:
        old = tables[name].join(mine, "document_id", "left_anti")
        return old.unionByName(new[name].join(mine, "document_id", "left_semi").select(*old.columns))

    checks = tables["reg_checks"]
    read = ["reg_no", "status", "why"]
    fresh = new["reg_checks"].where("status > 0").join(done, "document_id", "left_semi").select("document_id", *(F.col(c).alias(f"_{c}") for c in read))
    both = checks.join(fresh.withColumn("_new", F.lit(True)), "document_id", "full")
    checks = both.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in read else F.col(c) for c in checks.columns))
    status = new["results"].join(free, "document_id", "left_semi").select("document_id", document_status(F.col("decision"), F.lit(False)).alias("_status"))
    documents = tables["documents"].join(status, "document_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return {"fields": swap("fields", done), "candidates": swap("candidates", free), "results": save_results(tables["results"], new["results"]), "reg_checks": checks, "documents": documents}


def save_settlements(settlements: DataFrame, candidates: DataFrame, new: DataFrame, new_candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settlements, candidates): new rows replace old ones and their documents' candidates; a document confirmed by a
    person keeps both."""
    fixed = settlements.where("status IN (2, 5)").select("document_id")
    mine = new.join(fixed, "document_id", "left_anti")
    others = candidates.join(mine.select("document_id"), "document_id", "left_anti")
    return upsert(settlements, mine, ["document_id"]), others.unionByName(new_candidates.join(mine.select("document_id"), "document_id", "left_semi"))


def refresh_reasons(settlements: DataFrame, reasons: DataFrame) -> DataFrame:
    """why alone, where it changed."""
    new = reasons.select("document_id", F.col("why").alias("_why"))
    return settlements.join(new, "document_id", "left").withColumn("why", F.coalesce("_why", "why")).drop("_why")


def approve(results: DataFrame, orders: DataFrame) -> DataFrame:
    """results after orders (order_id, document_id, decision 2 to 4, partner_id, decided_by, decided_at); the last order of
    a document wins. Carries before and after as JSON, the action and the document's status."""
    last = orders.groupBy("document_id").agg(F.max_by(F.struct("decision", "partner_id", "decided_by", "decided_at"), "order_id").alias("n"))
    fields = ["decision", "partner_id", "decided_by", "decided_at"]
    both = results.join(last, "document_id")
    after = {f: F.col(f"n.{f}") for f in fields} | {"partner_id": F.when(F.col("n.decision") == 3, F.col("n.partner_id")).otherwise(F.col("partner_id"))}
    changed = both.select(
        "document_id", *(c.alias(f) for f, c in after.items()), F.to_json(F.struct(*fields)).alias("before"),
        F.to_json(F.struct(*(c.alias(f) for f, c in after.items()))).alias("after"), decision_action(F.col("n.decision")).alias("action"), document_status(F.col("n.decision"), F.lit(True)).alias("status"),
    )
    kept = results.join(last.select("document_id"), "document_id", "left_anti").select("document_id", *fields)
    return kept.withColumns({c: F.lit(None).cast("string") for c in ("before", "after", "action")} | {"status": document_status(F.col("decision"), F.col("decided_by").isNotNull())}).unionByName(changed)


def learn_aliases(orders: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that corrections (decision 3 with a partner and an alias) teach and aren't known: source 2."""
    taught = orders.where("decision = 3 AND partner_id IS NOT NULL AND alias IS NOT NULL AND alias != ''").select("partner_id", "alias").distinct()
    return append_new(aliases, taught, ["partner_id", "alias"]).withColumn("source", F.lit(2))


def forget_aliases(aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """aliases without the asked ones; only learned ones of the asking organisation go."""
    gone = asked.select("alias_id", "organization_id").withColumn("source", F.lit(2))
    return aliases.join(gone, ["alias_id", "organization_id", "source"], "left_anti")


def seed_masters(partners: DataFrame, masters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new partners, their aliases) of clients that have no partner yet; variants other than the canonical name are aliases."""
    fresh = masters.join(partners.select("client_id").distinct(), "client_id", "left_anti")
    names = fresh.select("client_id", "partner_id", F.col("canonical").alias("name"))
    variants = fresh.select("partner_id", "canonical", F.explode("variants").alias("alias")).where("alias != canonical").select("partner_id", "alias").distinct().withColumn("source", F.lit(1))
    return names, variants


def apply_subscription_event(event: dict[str, Column], old: dict[str, Column], now: Column) -> dict[str, Column]:
    """status and grace_until after one event. canceled stays; a grace period isn't extended, and ends with a success."""
    failed, paid = F.coalesce(event["payment_failed"], F.lit(False)), F.coalesce(event["payment_succeeded"], F.lit(False))
    had = F.coalesce(old["status"], F.lit("active"))
    implied = F.when(failed & had.isin("active", "trialing"), F.lit("past_due")).when(paid & had.isin("past_due", "unpaid"), F.lit("active")).otherwise(had)
    said = F.when(F.coalesce(event["status"], F.lit("")) != "", event["status"]).otherwise(implied)
    status = F.when(old["status"].eqNullSafe(F.lit("canceled")), F.lit("canceled")).otherwise(said)
    good = paid | event["status"].eqNullSafe(F.lit("active"))
    grace = F.when(good, F.lit(None).cast("timestamp")).when(failed, F.coalesce(old["grace_until"], grace_end(now))).otherwise(old["grace_until"])
    return {"status": status, "grace_until": grace}


def confirm_settlements(settlements: DataFrame, orders: DataFrame) -> DataFrame:
    """settlements after a person confirmed a transaction (status 2) or cash (5): orders (document_id, status,
    transaction_id and, where settlements have them, decided_by, decided_at, why). Candidates are kept apart and stay."""
    new = orders.select("document_id", F.when(F.col("status") == 2, F.col("transaction_id")).alias("transaction_id"), F.col("status").cast("int").alias("status"), *(c for c in orders.columns if c in settlements.columns and c not in ("document_id", "transaction_id", "status")))
    old = settlements.withColumn("status", F.col("status").cast("int"))
    return old.join(new.select("document_id"), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)

"""The endpoints as methods over tables of one root folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize
from .functions.values import LOWER, UPPER, billing_verdict, decision_action
from .operators import audit, decision, ledger, linkage, mutations, reads, settlement, states
from .operators.staging import staged
from .sources import readers


class Engine:
    """Tables are Parquet under root, one folder each. A new version of a table is written beside it, then the folders
    change names, so a job that is lost leaves the old one whole. Methods that change what a person may ask about write
    their audit rows after it. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        new, old = (f"{self.root}/_{name}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
        df.write.parquet(new)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(path(f"{self.root}/{name}")) and not fs.rename(path(f"{self.root}/{name}"), path(old)):
            raise OSError(f"{name} can't be set aside")
        if not fs.rename(path(new), path(f"{self.root}/{name}")):
            fs.rename(path(old), path(f"{self.root}/{name}"))
            raise OSError(f"{name} can't be replaced")
        fs.delete(path(old), True)
        self.spark.catalog.refreshByPath(f"{self.root}/{name}")

    def append(self, name: str, df: DataFrame) -> None:
        staged(df, name).write.mode("append").parquet(f"{self.root}/{name}")

    def scoped(self, name: str, organization_id: int) -> DataFrame:
        return reads.scoped(self.table(name), self.table("clients"), organization_id)

    # Documents

    def ingest_documents(self, uploads: DataFrame, now: Column) -> None:
        docs, jobs = mutations.create_documents(uploads, self.table("clients"), now)
        docs = staged(docs, "documents")
        self.append("documents", docs)
        self.append("jobs", jobs.join(docs.select("document_id"), "document_id", "left_semi"))

    def match(self, queries: DataFrame, top: int = 5) -> DataFrame:
        """queries (client_id, query_id, text) to ranked partners."""
        forms = staged(linkage.build_forms(self.table("partners"), self.table("aliases")), "forms")
        return linkage.match(queries.withColumn("norm", normalize(F.col("text"))), forms, top)

    def document_view(self, organization_id: int, top: int = 5) -> DataFrame:
        docs = self.scoped("documents", organization_id)
        return reads.document_view(docs, self.table("fields"), self.table("results"), self.table("partners"), self.table("candidates"), reads.clamp(top, 0, 50, 5))

    def save_result(self, new: dict[str, DataFrame], at: Column) -> None:
        """Saves what reading and matching gave for documents: fields, candidates, results (also threshold_id, score and
        why), reg_checks; then the audit rows of the decisions."""
        names = ["fields", "candidates", "results", "reg_checks", "documents"]
        tables = {n: self.table(n) for n in names}
        new = {k: staged(v, k) for k, v in new.items()}
        owners = tables["documents"].join(self.table("clients"), "client_id").select("document_id", "organization_id")
        extra = lambda c: c if c in new["results"].columns else F.lit(None).cast("string").alias(c)
        done = new["results"].select("document_id", "decision", "partner_id", extra("threshold_id"), extra("score"), extra("why"))
        rows = done.join(owners, "document_id").select(
            "organization_id", F.lit(None).cast("long").alias("actor_id"), F.lit("match_results").alias("target_table"), F.col("document_id").alias("target_id"), decision_action(F.col("decision")).alias("action"),
            F.lit(None).cast("string").alias("before"), F.to_json(F.struct("partner_id", "score", "why")).alias("after"), F.col("threshold_id").cast("long").alias("threshold_id"), at.alias("occurred_at"),
        )
        rows = staged(rows, "audit")
        after = {n: staged(df, n) for n, df in mutations.save_result(tables, new | {"results": new["results"].select(*tables["results"].columns)}).items()}
        for n, df in after.items():
            self.replace(n, df)
        self.record(rows)

    def apply_decisions(self, organization_id: int, orders: DataFrame, at: Column) -> DataFrame:
        """Saves an organisation's decisions on its own documents, their status and what corrections teach, each with an
        audit row; returns the changed rows with what was before and after. Orders on other documents do nothing."""
        mine = staged(orders.join(self.scoped("documents", organization_id).select("document_id"), "document_id", "left_semi"), "orders")
        done = staged(mutations.approve(self.table("results"), mine), "decisions")
        aliases = self.table("aliases")
        own = self.scoped("partners", organization_id).select("partner_id")
        taught = mutations.learn_aliases(mine.join(own, "partner_id", "left_semi"), aliases).withColumn("alias_id", F.xxhash64("partner_id", "alias"))
        taught = staged(taught.select(*aliases.columns), "taught")
        changed = done.where("action IS NOT NULL")
        self.replace("results", done.select("document_id", "decision", "partner_id", "decided_by", "decided_at"))
        documents = self.table("documents")
        status = changed.select("document_id", F.col("status").alias("_status"))
        self.replace("documents", documents.join(status, "document_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status"))
        self.append("aliases", taught)
        row = lambda table, id_, action, before, after, actor: [F.lit(organization_id).cast("long").alias("organization_id"), actor.alias("actor_id"), F.lit(table).alias("target_table"), F.col(id_).alias("target_id"), action.alias("action"), before.alias("before"), after.alias("after"), F.lit(None).cast("long").alias("threshold_id"), at.alias("occurred_at")]
        who = mine.where("decision = 3").groupBy("partner_id", "alias").agg(F.max("decided_by").alias("actor"))
        learned = taught.join(who, ["partner_id", "alias"])
        rows = changed.select(*row("match_results", "document_id", F.col("action"), F.col("before"), F.col("after"), F.col("decided_by")))
        self.record(rows.union(learned.select(*row("partner_aliases", "alias_id", F.lit("learn_alias"), F.lit(None).cast("string"), F.to_json(F.struct("partner_id", "alias")), F.col("actor")))))
        return changed

    def learned_aliases(self, organization_id: int, top: int | None = None) -> DataFrame:
        return reads.learned_aliases(self.table("aliases"), self.scoped("partners", organization_id), reads.clamp(top, 1, 500, 100))

    def forget_aliases(self, asked: DataFrame, actor_id: int, at: Column) -> None:
        """asked (alias_id, organization_id); audit rows keep what was forgotten."""
        owners = self.table("partners").join(self.table("clients"), "client_id").select("partner_id", "organization_id")
        aliases = self.table("aliases")
        owned = aliases.join(owners, "partner_id")
        gone = owned.where("source = 2").join(asked, ["alias_id", "organization_id"], "left_semi")
        rows = staged(gone.select(
            "organization_id", F.lit(actor_id).cast("long").alias("actor_id"), F.lit("partner_aliases").alias("target_table"), F.col("alias_id").alias("target_id"), F.lit("forget_alias").alias("action"),
            F.to_json(F.struct("partner_id", "alias")).alias("before"), F.lit(None).cast("string").alias("after"), F.lit(None).cast("long").alias("threshold_id"), at.alias("occurred_at"),
        ), "forgotten")
        self.replace("aliases", mutations.forget_aliases(owned, asked).select(*aliases.columns))
        self.record(rows)

    # Ledger and settlement

    def import_ledger(self, path: str, kind: str, client_id: int) -> tuple[DataFrame, DataFrame]:
        """Reads statements, appends what is new; returns (counts of inserted and skipped rows by file, rejected files)."""
        rows, bad = readers.read_statements(self.spark, path, kind)
        old = self.table("transactions")
        fresh = ledger.new_files(ledger.canonical(rows).withColumn("client_id", F.lit(client_id).cast("long")), old.select("client_id", "file_sha256").distinct())
        fresh = staged(fresh.withColumns({"batch_id": F.col("file_sha256"), "transaction_id": F.xxhash64("row_fingerprint", F.lit(client_id))}), "rows")
        new, counts = ledger.import_rows(fresh, old)
        counts = staged(counts, "counts")
        self.append("transactions", new.select(*old.columns))
        return counts, bad

    def settle(self, at: Column, clients: DataFrame | None = None, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
        """Settles what no person has settled, of some clients (rows of client_id) or of all; saves the rows that changed with their candidates,
        reasons and audit rows, and new reasons of rows that didn't change; returns the changed rows."""
        only = lambda df: df if clients is None else df.join(clients.select("client_id"), "client_id", "left_semi")
        docs = staged(settlement.targets(only(self.table("documents")), self.table("fields"), self.table("settlements")), "targets")
        partners, aliases = only(self.table("partners")), self.table("aliases")
        own = docs.select("document_id", F.col("issuer_name").alias("form"))
        found = self.table("results").where("partner_id IS NOT NULL").select("document_id", "partner_id").join(docs.select("document_id"), "document_id", "left_semi")
        named = found.join(partners.select("partner_id", F.col("name").alias("form")).union(aliases.select("partner_id", "alias")), "partner_id").select("document_id", "form")
        forms = own.union(named).select("document_id", normalize(F.col("form")).alias("norm")).distinct()
        names = partners.select("client_id", "name", F.col("name").alias("form")).union(aliases.join(partners, "partner_id").select("client_id", "name", "alias"))
        old = self.table("settlements")
        txs, names = only(self.table("transactions")), names.select("client_id", "name", normalize(F.col("form")).alias("norm"))
        out, best = settlement.settle(docs, txs, forms, names, old, upper, lower)
        out = staged(settlement.with_reasons(out, settlement.name_lists(best, names), upper, lower), "reasoned")
        owners = docs.join(self.table("clients"), "client_id").select("document_id", "organization_id")
        changed = out.where("changed")
        rows = staged(changed.join(owners, "document_id").select(
            "organization_id", F.lit(None).cast("long").alias("actor_id"), F.lit("settlements").alias("target_table"), F.col("document_id").alias("target_id"),
            F.when(F.col("status") == 1, "settle_auto").when(F.col("status") == 3, "settle_review").otherwise("settle_none").alias("action"), F.lit(None).cast("string").alias("before"),
            F.to_json(F.struct("status", "transaction_id", "score", "why")).alias("after"), F.lit(None).cast("long").alias("threshold_id"), at.alias("occurred_at"),
        ), "audit")
        kept = self.table("settlement_candidates")
        told = docs.join(changed.select("document_id"), "document_id", "left_semi")
        fresh = settlement.ranked(settlement.candidates(told, txs, forms, names, [*settlement.CANDIDATE, "rank"], upper, lower)).select(*kept.columns)
        new = changed.select(*(c if c in changed.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns))
        after, candidates = mutations.save_settlements(old, kept, new, fresh)
        candidates = staged(candidates, "candidates")
        self.replace("settlements", mutations.refresh_reasons(after, out.where("not changed").select("document_id", "why")))
        self.replace("settlement_candidates", candidates)
        self.record(rows)
        return changed.select("document_id", "transaction_id", "status", "why")

    def confirm_settlements(self, organization_id: int, orders: DataFrame, at: Column) -> None:
        """An organisation's confirmations (document_id, status 2 or 5, transaction_id, decided_by) of its own documents."""
        mine = staged(orders.join(self.scoped("documents", organization_id).select("document_id"), "document_id", "left_semi"), "orders")
        old = self.table("settlements")
        before = old.select("document_id", F.to_json(F.struct("status", "transaction_id")).alias("before"))
        rows = staged(mine.join(before, "document_id", "left").select(
            F.lit(organization_id).cast("long").alias("organization_id"), F.col("decided_by").alias("actor_id"), F.lit("settlements").alias("target_table"), F.col("document_id").alias("target_id"),
            F.when(F.col("status") == 5, "settle_cash").otherwise("settle_confirm").alias("action"), "before", F.to_json(F.struct("status", "transaction_id")).alias("after"), F.lit(None).cast("long").alias("threshold_id"), at.alias("occurred_at"),
        ), "audit")
        self.replace("settlements", mutations.confirm_settlements(old, mine).select(*old.columns))
        self.record(rows)

    # Thresholds

    def simulate(self, organization_id: int, upper: float, lower: float) -> DataFrame:
        mine = self.scoped("documents", organization_id).select("document_id")
        return decision.simulate(self.table("candidates").where("rank = 1").join(mine, "document_id", "left_semi"), upper, lower)

    def apply_threshold(self, new: DataFrame) -> None:
        self.replace("thresholds", decision.apply_threshold(self.table("thresholds"), new))

    # Audit and billing

    def record(self, rows: DataFrame) -> None:
        """Appends rows to the audit log, numbered on from its last one and chained to it."""
        log = self.table("audit_logs")
        last = audit.last_hash(log).first()
        rows = staged(audit.entries(rows, log), "entries")
        self.append("audit_logs", audit.chain(rows, last["row_hash"]).select(*log.columns))

    def verify_audit(self, from_id: int | None = None, to_id: int | None = None) -> DataFrame:
        return audit.verify(self.table("audit_logs"), from_id, to_id)

    def billing(self, now: Column) -> DataFrame:
        """Whether each organisation may take documents, why, and what to do: organization_id and billing_verdict()'s fields."""
        both = reads.latest_subscription(self.table("organizations"), self.table("subscriptions"))
        verdict = billing_verdict(*(F.col(c) for c in ("billing_exempt", "status", "grace_until", "cancel_at_period_end", "current_period_end")), now)
        return both.select("organization_id", verdict.alias("v")).select("organization_id", "v.*")

    def subscription_states(self, events: DataFrame) -> DataFrame:
        return states.fold_subscriptions(events)

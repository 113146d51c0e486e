import datetime

from pyspark.sql import functions as F

from ledgerline.engine import Engine
from ledgerline.functions.text import normalize
from ledgerline.sources import generators

D, T = datetime.date, datetime.datetime


def test_from_statement_to_settlement(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{e.root}/{name}")
    put("organizations", [(1, False)], "organization_id long, billing_exempt boolean")
    put("clients", [(1, 1, 1), (2, 2, 1)], "client_id long, organization_id long, default_direction int")
    put("partners", [(1, 1, "株式会社ヤマト商事"), (2, 1, "サクラ工業"), (3, 2, "他人")], "partner_id long, client_id long, name string")
    put("aliases", [(9, 2, "サクラ", 2), (8, 3, "たにん", 2)], "alias_id long, partner_id long, alias string, source int")
    put("documents", [], "document_id long, client_id long, direction int, source_name string, status int, uploaded_at timestamp")
    put("jobs", [], "document_id long, status int, attempts int, max_attempts int, run_after timestamp")
    put("fields", [(5, "total", "1258", 1), (5, "issue_date", "2026-07-15", 2), (5, "issuer_name", "ヤマト商事", 3)], "document_id long, field_key string, value string, id long")
    put("results", [(5, 5, 1, None, T(2026, 7, 16))], "document_id long, decision int, partner_id long, decided_by long, decided_at timestamp")
    put("candidates", [(5, 1, 1, 88.0)], "document_id long, partner_id long, rank int, score double")
    put("settlements", [], "document_id long, transaction_id long, status int, score double, why string")
    put("settlement_candidates", [], "document_id long, transaction_id long, rank int, score decimal(5,1), name_score decimal(5,1), amount_score decimal(5,1), date_score decimal(5,1)")
    put("reg_checks", [(5, None, 1, "old", T(2026, 7, 1))], "document_id long, reg_no string, status int, why string, looked_up_at timestamp")
    put("audit_logs", [], "id long, organization_id long, actor_id long, target_table string, target_id long, action string, before string, after string, threshold_id long, occurred_at timestamp, prev_hash string, row_hash string, hash_version int")
    put("transactions", [], "transaction_id long, client_id long, batch_id string, file_sha256 string, source_type int, direction int, transaction_date date, amount long, description string, normalized_name string, row_fingerprint string")
    put("subscriptions", [(1, 1, "active", None, True, T(2026, 8, 1))], "subscription_id long, organization_id long, status string, grace_until timestamp, cancel_at_period_end boolean, current_period_end timestamp")
    now = F.to_timestamp(F.lit("2026-07-20 00:00:00"))

    e.ingest_documents(spark.createDataFrame([(5, 1, 0, "a.pdf"), (6, 7, 1, "b.pdf")], "document_id long, client_id long, direction int, source_name string"), now)
    assert [(r.document_id, r.direction) for r in e.table("documents").collect()] == [(5, 1)] and e.table("jobs").count() == 1
    (tmp_path / "s.csv").write_text("日付,摘要,出金額,入金額\n2026/07/15,ｶ)ﾔﾏﾄ商事,1258,\n2026/07/15,ｶ)ﾔﾏﾄ商事,1258,\n", encoding="utf-8")
    counts, bad = e.import_ledger(f"file://{tmp_path}/s.csv", "bank", 1)
    assert counts.first().inserted == 2 and bad.count() == 0
    counts, _ = e.import_ledger(f"file://{tmp_path}/s.csv", "bank", 1)
    assert counts.count() == 0 and e.table("transactions").count() == 2
    counts, _ = e.import_ledger(f"file://{tmp_path}/s.csv", "bank", 2)
    assert counts.first().inserted == 2 and e.table("transactions").where("client_id = 2").count() == 2
    client = lambda i: spark.createDataFrame([(i,)], "client_id long")
    assert e.settle(now, client(2)).count() == 0
    first = e.settle(now, client(1)).collect()
    assert [(r.document_id, r.status) for r in first] == [(5, 1)] and "is at least" in first[0].why
    assert [r.rank for r in e.table("settlement_candidates").orderBy("rank").collect()] == [1, 2]
    assert e.settle(now).count() == 0
    order = lambda d, s: spark.createDataFrame([(d, s, None, 7)], "document_id long, status int, transaction_id long, decided_by long")
    e.confirm_settlements(2, order(5, 5), now)
    assert e.table("settlements").first().status == 1
    e.confirm_settlements(1, order(5, 5), now)
    assert e.table("settlements").first().status == 5 and e.settle(now).count() == 0

    asked = spark.createDataFrame([(1, 5, 3, 2, 7, T(2026, 7, 17), "さくら")], "order_id long, document_id long, decision int, partner_id long, decided_by long, decided_at timestamp, alias string")
    assert e.apply_decisions(2, asked, now).count() == 0
    done = e.apply_decisions(1, asked, now)
    assert done.first().action == "correct" and e.table("results").first().partner_id == 2 and e.learned_aliases(1).count() == 2 and e.learned_aliases(2).count() == 1
    assert e.table("documents").first().status == 5
    e.forget_aliases(spark.createDataFrame([(9, 1), (8, 1)], "alias_id long, organization_id long"), 7, now)
    assert [r.alias for r in e.learned_aliases(1).collect()] == ["さくら"] and e.learned_aliases(2).count() == 1
    log = e.table("audit_logs").orderBy("id").collect()
    assert [(r.id, r.target_table, r.action, r.actor_id) for r in log] == [(1, "settlements", "settle_auto", None), (2, "settlements", "settle_cash", 7), (3, "match_results", "correct", 7), (4, "partner_aliases", "learn_alias", 7), (5, "partner_aliases", "forget_alias", 7)]
    assert '"status":1' in log[1].before and e.verify_audit().count() == 0

    new = {
        "fields": spark.createDataFrame([(5, "total", "9", 9)], "document_id long, field_key string, value string, id long"), "candidates": spark.createDataFrame([(5, 1, 1, 99.0)], "document_id long, partner_id long, rank int, score double"),
        "results": spark.createDataFrame([(5, 1, 1, None, T(2026, 7, 18), "sure", 98.5)], "document_id long, decision int, partner_id long, decided_by long, decided_at timestamp, why string, score double"),
        "reg_checks": spark.createDataFrame([(5, "T7000012050002", 4, "fine")], "document_id long, reg_no string, status int, why string"),
    }
    e.save_result(new, now)
    assert [r.value for r in e.table("fields").collect()] == ["9"] and e.table("results").first().decision == 3  # a person's decision stays
    check = e.table("reg_checks").first()
    assert (check.status, check.why, check.looked_up_at) == (4, "fine", T(2026, 7, 1)) and e.table("candidates").first().score == 88.0
    q = spark.createDataFrame([(1, 1, "ヤマト商")], "client_id long, query_id long, text string")
    assert e.match(q).first().partner_id == 1
    assert e.simulate(1, 95, 55).first().review == 1 and e.simulate(2, 95, 55).first().total == 0
    assert e.document_view(1).first().partner_name == "サクラ工業" and e.billing(now).first().allowed
    assert e.billing(now).first().reason == "ends on 2026-08-01"


def test_generated_forms_add_up(spark):
    masters = generators.masters(spark, 50)
    forms = generators.forms(masters, 120)
    rows = forms.collect()
    assert len(rows) == 120 and all(r.total == sum(x.amount for x in r["rows"]) and r.total_with_tax == r.total + r.total // 10 for r in rows)
    assert {r.preset for r in rows} == set(generators.PRESETS) and all(abs(r.angle) <= generators.PRESETS[r.preset]["angle"] for r in rows)
    core = masters.select("partner_id", normalize(F.col("canonical")).alias("n"))
    assert forms.select("partner_id", normalize(F.col("partner_name")).alias("n")).join(core, ["partner_id", "n"]).count() == 120

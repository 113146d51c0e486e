"""Linkage and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import decision, evaluate, linkage
from ..operators.staging import spread, staged
from .model import model
from .registry import query
from .sqltext import combined, grams, jac, lev, metrics, norm, trigrams

FORMS = f"""forms AS (
  SELECT client_id, partner_id, form, is_canonical, norm, {trigrams("norm")} AS trgm, {grams("norm")} AS grams FROM (
    SELECT *, {norm("form")} AS norm FROM (
      SELECT client_id, partner_id, name AS form, true AS is_canonical FROM {{partners}}
      UNION ALL SELECT p.client_id, p.partner_id, a.alias, false FROM {{aliases}} a JOIN {{partners}} p USING (partner_id)))
), q AS (SELECT client_id, query_id, truth_id, norm, {trigrams("norm")} AS trgm, {grams("norm")} AS grams FROM (SELECT *, {norm("text")} AS norm FROM {{queries}}))"""
BLOCKED = f"""WITH {FORMS}, sims AS (
  SELECT client_id, query_id, q.norm, partner_id, max(sim) AS sim FROM (
    SELECT q.client_id, q.query_id, q.norm, f.partner_id, len(list_intersect(q.trgm, f.trgm))::DOUBLE / len(list_distinct(list_concat(q.trgm, f.trgm))) AS sim
    FROM q JOIN forms f ON q.client_id = f.client_id) q WHERE sim >= 0.3 - 1e-12 GROUP BY ALL
), blocked AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, partner_id) <= 50)"""
SCORED = f"""{BLOCKED}, scored AS (
  SELECT *, {combined()} AS score FROM (
    SELECT b.client_id, b.query_id, b.partner_id, b.sim, f.form, f.is_canonical, {metrics("b.norm", "f.norm", grams("b.norm"), "f.grams")}
    FROM blocked b JOIN forms f ON b.client_id = f.client_id AND b.partner_id = f.partner_id)
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, partner_id ORDER BY score DESC, is_canonical DESC, form DESC) = 1
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, is_canonical DESC, partner_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 5
)"""


def forms(spark: SparkSession, d: str) -> DataFrame:
    # The driver's file of parts is one row group.
    return staged(linkage.build_forms(spread(model(spark, d, "partners"), "partner_id"), spread(model(spark, d, "aliases"), "partner_id")), "forms")


def queries(spark: SparkSession, d: str) -> DataFrame:
    q = model(spark, d, "queries")
    return staged(q.withColumn("norm", text.normalize(F.col("text"))), "queries")


def matched(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match(queries(spark, d), forms(spark, d))


@query(f"SELECT partner_id, {norm('name')} AS norm FROM {{partners}}")
def normalize_names(spark, d):
    return model(spark, d, "partners").select("partner_id", text.normalize(F.col("name")).alias("norm"))


@query(f"SELECT partner_id, gram, count(*) AS n FROM (SELECT partner_id, unnest({grams('norm')}) AS gram FROM (SELECT partner_id, {norm('name')} AS norm FROM {{partners}})) GROUP BY ALL")
def ngram_explode(spark, d):
    n = normalize_names(spark, d)
    return n.select("partner_id", F.explode(text.ngrams(F.col("norm"))).alias("gram")).groupBy("partner_id", "gram").agg(F.count("*").alias("n"))


PAIRS = f"{BLOCKED}, pairs AS (SELECT b.query_id AS a_id, b.partner_id AS b_id, b.norm AS a, f.norm AS b FROM blocked b JOIN forms f ON b.client_id = f.client_id AND b.partner_id = f.partner_id AND f.is_canonical)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of all queries with the partner's own name."""
    f = forms(spark, d)
    own = f.where("is_canonical").select("client_id", F.col("partner_id").alias("b_id"), F.col("norm").alias("b"))
    found = linkage.trigram_candidates(queries(spark, d), f).select("client_id", F.col("query_id").alias("a_id"), F.col("partner_id").alias("b_id"), F.col("norm").alias("a"))
    return found.join(own, ["client_id", "b_id"]).select("a_id", "b_id", "a", "b")


@query(f"{PAIRS} SELECT a_id, b_id, round({lev('a', 'b')}, 6) AS sim FROM pairs")
def levenshtein_pairs(spark, d):
    return pairs(spark, d).select("a_id", "b_id", F.round(similarity.levenshtein_sim(F.col("a"), F.col("b")), 6).alias("sim"))


@query(f"{PAIRS} SELECT a_id, b_id, round({jac(grams('a'), grams('b'))}, 6) AS sim FROM pairs")
def jaccard_pairs(spark, d):
    return pairs(spark, d).select("a_id", "b_id", F.round(similarity.jaccard_sim(text.ngrams(F.col("a")), text.ngrams(F.col("b"))), 6).alias("sim"))


@query(f"{PAIRS} SELECT a_id, b_id, round(prefix, 6) AS prefix_sim, round(suffix, 6) AS suffix_sim FROM (SELECT a_id, b_id, {metrics('a', 'b', grams('a'), grams('b'))} FROM pairs)")
def prefix_suffix_pairs(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select("a_id", "b_id", F.round(similarity.prefix_sim(a, b), 6).alias("prefix_sim"), F.round(similarity.suffix_sim(a, b), 6).alias("suffix_sim"))


@query(f"{PAIRS} SELECT a_id, b_id, round({combined()}, 6) AS score FROM (SELECT a_id, b_id, {metrics('a', 'b', grams('a'), grams('b'))} FROM pairs)")
def combined_score(spark, d):
    return linkage.score_pairs(pairs(spark, d), "a", "b").select("a_id", "b_id", F.round("score", 6).alias("score"))


@query(f"{BLOCKED} SELECT query_id, partner_id, round(sim, 6) AS sim FROM blocked")
def trigram_block(spark, d):
    return linkage.trigram_candidates(queries(spark, d), forms(spark, d)).select("query_id", "partner_id", F.round("sim", 6).alias("sim"))


@query(f"""WITH {FORMS} SELECT query_id, partner_id, form, shared, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query_id, partner_id, form, shared, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, is_canonical DESC, partner_id, form) AS rank FROM (
    SELECT q.query_id, f.partner_id, f.form, f.is_canonical, CAST(len(list_intersect(q.grams, f.grams)) AS BIGINT) AS shared FROM q JOIN forms f ON q.client_id = f.client_id)
  WHERE shared > 0) WHERE rank <= 15""")
def shared_gram_topk(spark, d):
    return linkage.shared_gram_candidates(queries(spark, d), forms(spark, d), 15).select("query_id", "partner_id", "form", "shared", "rank")


@query(f"{SCORED} SELECT query_id, partner_id, form AS matched, round(score, 6) AS score FROM best")
def best_alias_fold(spark, d):
    f, q = forms(spark, d), queries(spark, d)
    return q.join(linkage.best_candidates(q, f), ["client_id", "norm"]).select("query_id", "partner_id", "matched", F.round("score", 6).alias("score"))


@query(f"{SCORED} SELECT query_id, partner_id, rank, form AS matched, round(score, 6) AS score FROM ranked")
def match_topk(spark, d):
    return matched(spark, d).select("query_id", "partner_id", "rank", "matched", F.round("score", 6).alias("score"))


@query(f"""{SCORED} SELECT q.query_id, CASE WHEN decision < 3 THEN partner_id END AS partner_id, decision, CASE decision WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 4 END AS code,
  CASE WHEN score > 0 THEN CAST(score AS DECIMAL(5,2)) END AS stored_score FROM (
    SELECT q.query_id, r.partner_id, r.score, CASE WHEN r.score IS NULL THEN 3 WHEN r.score >= 95 THEN 1 WHEN r.score >= 55 THEN 2 ELSE 3 END AS decision
    FROM q LEFT JOIN ranked r ON q.query_id = r.query_id AND r.rank = 1) q""")
def match_decide(spark, d):
    best = matched(spark, d).where("rank = 1").select("query_id", "partner_id", "score")
    all_ = queries(spark, d).select("query_id").join(best, "query_id", "left")
    return decision.decisions(all_).select("query_id", "partner_id", "decision", "code", "stored_score")


@query(f"""{SCORED}, hit AS (SELECT q.query_id, min(r.rank) AS hit_rank FROM q LEFT JOIN ranked r ON q.query_id = r.query_id AND r.partner_id = q.truth_id GROUP BY q.query_id)
SELECT count(*) AS n, count(*) FILTER (hit_rank = 1) AS top1, count(*) FILTER (hit_rank <= 5) AS top5, count(*) FILTER (hit_rank IS NULL) AS missed FROM hit""")
def match_accuracy(spark, d):
    truth = model(spark, d, "queries").select("query_id", F.col("truth_id").alias("partner_id"))
    return evaluate.match_accuracy(matched(spark, d), truth)


@query("SELECT count(*) AS total, count(*) FILTER (score >= 95) AS auto, count(*) FILTER (score >= 55 AND score < 95) AS review, count(*) FILTER (score < 55) AS reject FROM {scores} WHERE rank = 1")
def threshold_simulate(spark, d):
    return decision.simulate(model(spark, d, "scores").where("rank = 1"), 95, 55)


@query("SELECT client_id, doc_type, count(*) AS total, count(*) FILTER (score >= 90) AS auto, count(*) FILTER (score >= 60 AND score < 90) AS review, count(*) FILTER (score < 60) AS reject FROM {scores} JOIN {docs} d USING (document_id) WHERE rank = 1 GROUP BY ALL")
def threshold_simulate_by_client(spark, d):
    docs = model(spark, d, "docs").select("document_id", "client_id", "doc_type")
    return decision.simulate(model(spark, d, "scores").where("rank = 1").join(docs, "document_id"), 90, 60, ["client_id", "doc_type"])


@query("SELECT CAST(b AS INTEGER) AS bucket, count(score) AS n FROM range(10) t(b) LEFT JOIN (SELECT score FROM {scores} WHERE rank = 1) s ON least(floor(score / 10), 9) = b GROUP BY b")
def score_histogram(spark, d):
    return decision.histogram(model(spark, d, "scores").where("rank = 1"))


@query("SELECT CAST(u AS INTEGER) AS upper, count(*) FILTER (score >= u) AS auto, count(*) FILTER (score >= u AND NOT correct) AS wrong FROM {judged}, (SELECT unnest([100, 99, 95, 90, 85, 80, 75, 70]) AS u) GROUP BY u")
def threshold_sweep(spark, d):
    return decision.sweep(model(spark, d, "judged"))


@query("SELECT CAST(min(u) AS INTEGER) AS best_upper FROM (SELECT u, count(*) FILTER (score >= u AND NOT correct) AS wrong FROM {judged}, (SELECT unnest([100, 99, 95, 90, 85, 80, 75, 70]) AS u) GROUP BY u) WHERE wrong = 0")
def threshold_safest(spark, d):
    return decision.safest(decision.sweep(model(spark, d, "judged")))


@query("SELECT correct, count(*) AS n, round(min(score), 6) AS lo, round(list_sort(list(score))[count(*) // 2 + 1], 6) AS median, round(avg(score), 6) AS mean, round(max(score), 6) AS hi FROM {judged} GROUP BY correct")
def score_stats_upper_median(spark, d):
    return decision.score_stats(model(spark, d, "judged")).select("correct", "n", *(F.round(c, 6).alias(c) for c in ("lo", "median", "mean", "hi")))


@query("SELECT wm AS wrong_max, rm AS right_min, count(*) FILTER (correct AND score < wm) AS right_below, count(*) FILTER (NOT correct AND score >= rm) AS wrong_above FROM {judged}, (SELECT max(score) FILTER (NOT correct) AS wm, min(score) FILTER (correct) AS rm FROM {judged}) GROUP BY ALL")
def score_overlap(spark, d):
    return decision.overlap(model(spark, d, "judged"))


@query("SELECT decision, count(*) FILTER (correct) AS correct_n, count(*) FILTER (NOT correct) AS wrong_n FROM {judged} GROUP BY decision")
def decision_confusion(spark, d):
    return decision.confusion(model(spark, d, "judged"))


GRID_SQL = ", ".join(f"({i}, {', '.join(f'{x}::DOUBLE' for x in w)})" for i, w in enumerate(decision.WEIGHT_GRID))


@query(f"""{SCORED}, top AS (
  SELECT weighting, query_id, partner_id, round(s, 9) AS r, s FROM (
    SELECT g.weighting, b.query_id, b.partner_id, 100 * (w1 * levenshtein + w2 * jaccard + w3 * prefix + w4 * suffix) / (w1 + w2 + w3 + w4) AS s
    FROM best b, (VALUES {GRID_SQL}) g(weighting, w1, w2, w3, w4)) QUALIFY row_number() OVER (PARTITION BY weighting, query_id ORDER BY r DESC, partner_id) = 1
) SELECT weighting, count(*) AS n, count(*) FILTER (partner_id = truth_id) AS top1, count(*) FILTER (s >= 95) AS auto, count(*) FILTER (s < 95 AND s >= 55) AS review, count(*) FILTER (s < 55) AS reject,
  count(*) FILTER (s >= 95 AND partner_id <> truth_id) AS wrong_auto FROM top JOIN q USING (query_id) GROUP BY weighting""")
def weight_sweep(spark, d):
    f, q = forms(spark, d), queries(spark, d)
    best = staged(linkage.best_candidates(q, f), "candidates")
    return decision.weight_sweep(q.select("client_id", "norm", "query_id", "truth_id").join(best, ["client_id", "norm"]))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    docs, clients = model(spark, d, "docs"), model(spark, d, "clients")
    return docs.join(clients.select("client_id", "organization_id"), "client_id").select(F.col("document_id").alias("subject_id"), "organization_id", "client_id", "partner_id", "doc_type")


@query("""SELECT subject_id, threshold_id, coalesce(upper, 95) AS upper, coalesce(lower, 55) AS lower FROM (
  SELECT d.document_id AS subject_id, t.threshold_id, t.upper, t.lower FROM {docs} d JOIN {clients} c USING (client_id)
  LEFT JOIN {thresholds} t ON t.organization_id = c.organization_id AND (t.client_id IS NULL OR t.client_id = d.client_id) AND (t.partner_id IS NULL OR t.partner_id = d.partner_id)
    AND (t.doc_type IS NULL OR t.doc_type = d.doc_type) AND t.valid_from <= DATE '2020-06-30' AND (t.valid_to IS NULL OR t.valid_to > DATE '2020-06-30')
  QUALIFY row_number() OVER (PARTITION BY d.document_id ORDER BY t.partner_id IS NOT NULL DESC, t.client_id IS NOT NULL DESC, t.doc_type IS NOT NULL DESC, t.valid_from DESC NULLS LAST, t.threshold_id DESC) = 1)""")
def threshold_precedence(spark, d):
    return decision.thresholds_for(subjects(spark, d), model(spark, d, "thresholds"), F.to_date(F.lit("2020-06-30"))).select("subject_id", "threshold_id", "upper", "lower")


@query("""SELECT threshold_id, valid_from, lead(valid_from) OVER (PARTITION BY organization_id, g ORDER BY valid_from, threshold_id) AS valid_to FROM (SELECT *, threshold_id % 2 AS g FROM {thresholds})""")
def threshold_generations(spark, d):
    t = model(spark, d, "thresholds").withColumns({"client_id": F.col("threshold_id") % 2, "partner_id": F.lit(None).cast("long"), "doc_type": F.lit(None).cast("int")})
    return decision.generations(t).select("threshold_id", "valid_from", "valid_to")


@query("""SELECT threshold_id, valid_from, CASE WHEN valid_to IS NULL AND threshold_id % 2 = 0 THEN DATE '2021-01-01' ELSE valid_to END AS valid_to FROM {thresholds}
  UNION ALL SELECT threshold_id + 1000, DATE '2021-01-01', NULL FROM {thresholds} WHERE threshold_id % 2 = 0 AND valid_to IS NULL""")
def threshold_scd2(spark, d):
    t = model(spark, d, "thresholds").withColumn("partner_id", F.col("threshold_id"))  # each its own scope
    new = t.where("threshold_id % 2 = 0 AND valid_to IS NULL").withColumns({"threshold_id": F.col("threshold_id") + 1000, "valid_from": F.to_date(F.lit("2021-01-01"))}).drop("valid_to")
    return decision.apply_threshold(t, new).select("threshold_id", "valid_from", "valid_to")


@query("""SELECT document_id, CASE WHEN raw_ok OR NOT pre_ok THEN 'raw' ELSE 'preprocessed' END AS variant FROM (
  SELECT document_id, document_id % 3 <> 0 AS raw_ok, document_id % 4 <> 0 AS pre_ok FROM {docs})""")
def retry_choice(spark, d):
    docs = model(spark, d, "docs")
    raw = docs.select("document_id", F.lit("raw").alias("variant"), F.lit("x").alias("name"), F.when(F.col("document_id") % 3 != 0, 4).otherwise(0).alias("candidates"))
    pre = docs.select("document_id", F.lit("preprocessed").alias("variant"), F.when(F.col("document_id") % 4 != 0, "y").otherwise("").alias("name"), F.lit(9).alias("candidates"))
    return decision.chosen_read(raw.unionByName(pre)).select("document_id", "variant")


SWEEP_SCORES = "SELECT CAST(document_id % 6 * 4 AS INT) AS trunc, document_id AS query_id, partner_id, CASE WHEN rank = 1 + document_id % 2 THEN partner_id ELSE partner_id + 1000 END AS truth_id, score AS name_score, score * 0.4 + 60 AS total_score, rank FROM {scores} WHERE rank <= 2"


def sweep_scores(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SWEEP_SCORES, scores=model(spark, d, "scores"))


@query(f"""WITH s AS ({SWEEP_SCORES}) SELECT trunc, count(*) FILTER (rank = 1) AS n, count(*) FILTER (rank = 1 AND partner_id = truth_id) AS right_top, count(*) FILTER (rank = 1 AND partner_id <> truth_id AND name_score >= 95) AS wrong_over,
  count(*) FILTER (rank = 1 AND name_score >= 95) AS auto_name, count(*) FILTER (rank = 1 AND name_score < 95 AND name_score >= 55) AS review_name, count(*) FILTER (rank = 1 AND name_score < 55) AS reject_name,
  count(*) FILTER (rank = 1 AND total_score >= 95) AS auto_total, count(*) FILTER (rank = 1 AND total_score < 95 AND total_score >= 55) AS review_total, count(*) FILTER (rank = 1 AND total_score < 55) AS reject_total,
  min(name_score) FILTER (partner_id = truth_id) AS right_min, list_sort(list(name_score) FILTER (partner_id = truth_id))[count(*) FILTER (partner_id = truth_id) // 2 + 1] AS right_median, max(name_score) FILTER (partner_id = truth_id) AS right_max
FROM s GROUP BY trunc""")
def truncation_sweep(spark, d):
    return evaluate.truncation_sweep(sweep_scores(spark, d))


@query(f"""WITH s AS ({SWEEP_SCORES}), b AS (SELECT trunc, query_id, max(name_score) FILTER (partner_id = truth_id) AS rn, max(name_score) FILTER (partner_id <> truth_id) AS wn, max(total_score) FILTER (partner_id = truth_id) AS rt, max(total_score) FILTER (partner_id <> truth_id) AS wt FROM s GROUP BY ALL)
SELECT trunc, count(*) FILTER (wn > rn) AS inverted, count(*) FILTER (wn > rn AND rt > wt) AS rescued FROM b GROUP BY trunc""")
def truncation_inversions(spark, d):
    return evaluate.inversions(sweep_scores(spark, d))


@query("""SELECT preset, count(*) AS n, CAST(sum(r) AS BIGINT) AS raw_hits, CAST(sum(p) AS BIGINT) AS pre_hits, CAST(sum(greatest(r, p)) AS BIGINT) AS either_hits FROM (
  SELECT CASE CAST(document_id % 3 AS INT) WHEN 0 THEN 'light' WHEN 1 THEN 'normal' ELSE 'heavy' END AS preset, CAST(document_id % 5 < 3 AS INT) AS r, CAST(document_id % 7 < 3 AS INT) AS p FROM {docs}) GROUP BY ROLLUP (preset)""")
def ocr_variant_hits(spark, d):
    docs = model(spark, d, "docs")
    preset = F.when(F.col("document_id") % 3 == 0, "light").when(F.col("document_id") % 3 == 1, "normal").otherwise("heavy").alias("preset")
    one = lambda v, c: docs.select(preset, "document_id", F.lit(v).alias("variant"), c.alias("hit"))
    return evaluate.variant_hits(one("raw", F.col("document_id") % 5 < 3).unionByName(one("preprocessed", F.col("document_id") % 7 < 3)))


@query("""SELECT field_key, count(*) AS n, count(*) FILTER (value = tv) AS exact, count(*) FILTER (regexp_replace(value, '[^0-9]', '', 'g') = regexp_replace(tv, '[^0-9]', '', 'g')) AS same_digits, count(*) FILTER (value IS NULL) AS missing FROM (
  SELECT field_key, value AS tv, CASE WHEN document_id % 11 = 0 THEN NULL WHEN document_id % 7 = 0 THEN value || '-' WHEN document_id % 5 = 0 THEN value || '9' ELSE value END AS value FROM {fields} QUALIFY row_number() OVER (PARTITION BY document_id, field_key ORDER BY id) = 1) GROUP BY field_key""")
def field_accuracy(spark, d):
    truth = evaluate.first_values(model(spark, d, "fields"))
    k = F.col("document_id")
    read = truth.where(k % 11 != 0).withColumn("value", F.when(k % 7 == 0, F.concat("value", F.lit("-"))).when(k % 5 == 0, F.concat("value", F.lit("9"))).otherwise(F.col("value")))
    return evaluate.field_accuracy(read, truth)


def _drawn(seed: int, *cols: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)})), 1, 15)) AS BIGINT)"


_CUT = f"CASE WHEN {_drawn(3, 'partner_id', 'form')} % 1000 < 500 AND length(form) > 2 THEN substr(form, 1, CAST(1 + {_drawn(2, 'form')} % (length(form) - 1) AS INT)) || substr(form, CAST(3 + {_drawn(2, 'form')} % (length(form) - 1) AS INT)) ELSE form END"
_BENCH = f"""{FORMS[: FORMS.index(", q AS (")]}, picked AS (SELECT *, {_drawn(1, "partner_id", "form")} AS query_id FROM forms ORDER BY query_id, partner_id, form LIMIT 500),
q AS (SELECT client_id, query_id, truth_id, norm, {trigrams("norm")} AS trgm, {grams("norm")} AS grams FROM (SELECT *, {norm("text")} AS norm FROM (SELECT client_id, query_id, partner_id AS truth_id, {_CUT} AS text FROM picked)))"""


@query(f"""{SCORED.replace(FORMS, _BENCH)}, hit AS (SELECT q.query_id, min(r.rank) AS hit_rank FROM q LEFT JOIN ranked r ON q.query_id = r.query_id AND r.partner_id = q.truth_id GROUP BY q.query_id)
SELECT count(*) AS n, count(*) FILTER (hit_rank = 1) AS top1, count(*) FILTER (hit_rank <= 5) AS top5, count(*) FILTER (hit_rank IS NULL) AS missed FROM hit""")
def bench_mode(spark, d):
    """500 written forms as queries, half of them with a character left out."""
    f = forms(spark, d)
    q = staged(evaluate.bench_queries(f, 500, noise=0.5).withColumn("norm", text.normalize(F.col("text"))), "queries")
    return evaluate.match_accuracy(linkage.match(q, f), q.select("query_id", "partner_id"))

"""Thresholds in force, decisions, and what-if questions over stored scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import combine
from ..functions.values import AUTO, LOWER, REJECT, REVIEW, UPPER, decide, decision_code


def thresholds_for(subjects: DataFrame, thresholds: DataFrame, at) -> DataFrame:
    """subjects (subject_id, organization_id, client_id, partner_id, doc_type) with the threshold in force at `at`.

    A null in a threshold is a wildcard. The most specific wins: partner, then client, then document type, then the
    latest valid_from, then the larger id. Where none fits, the defaults stand and threshold_id is null.
    """
    t = thresholds.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    scope = ["client_id", "partner_id", "doc_type"]
    t = t.select("threshold_id", "organization_id", *(F.col(c).alias(f"t_{c}") for c in scope), "upper", "lower", "valid_from")
    # Each subject asks for the eight scopes that fit it, so a threshold meets only subjects of its scope.
    options = [F.array(F.col(c), F.lit(None)) for c in scope]
    asked = F.flatten(F.flatten(F.transform(options[0], lambda c: F.transform(options[1], lambda p: F.transform(options[2], lambda k: F.struct(c.alias("c"), p.alias("p"), k.alias("k")))))))
    asked = subjects.select("subject_id", "organization_id", F.explode(F.array_distinct(asked)).alias("s")).select("subject_id", F.col("organization_id").alias("o"), "s.*")
    same = (F.col("o") == F.col("organization_id")) & F.col("c").eqNullSafe(F.col("t_client_id")) & F.col("p").eqNullSafe(F.col("t_partner_id")) & F.col("k").eqNullSafe(F.col("t_doc_type"))
    both = asked.join(t, same)
    special = F.struct(F.col("t_partner_id").isNotNull(), F.col("t_client_id").isNotNull(), F.col("t_doc_type").isNotNull(), F.col("valid_from"), F.col("threshold_id"))
    best = both.groupBy("subject_id").agg(F.max_by(F.struct("threshold_id", "upper", "lower"), special).alias("t"))
    out = subjects.join(best, "subject_id", "left")
    return out.select(*subjects.columns, F.col("t.threshold_id").alias("threshold_id"), F.coalesce("t.upper", F.lit(UPPER)).cast("double").alias("upper"), F.coalesce("t.lower", F.lit(LOWER)).cast("double").alias("lower"))


def apply_threshold(history: DataFrame, new: DataFrame) -> DataFrame:
    """A new generation for each scope in `new`: the open one of the same scope ends where the new one begins."""
    scope = ["organization_id", "client_id", "partner_id", "doc_type"]
    begins = new.select(*(F.col(c).alias(f"n_{c}") for c in scope), F.col("valid_from").alias("n_from"))
    same = F.lit(True)
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    closed = history.join(begins, same & F.col("valid_to").isNull(), "left").withColumn("valid_to", F.coalesce("valid_to", "n_from")).select(*history.columns)
    return closed.unionByName(new.withColumn("valid_to", F.lit(None).cast(history.schema["valid_to"].dataType)))


def generations(history: DataFrame) -> DataFrame:
    """valid_to of each generation from the beginning of the next one of its scope."""
    scope = ["organization_id", "client_id", "partner_id", "doc_type"]
    order = Window.partitionBy(*scope).orderBy("valid_from", "threshold_id")
    return history.withColumn("valid_to", F.lead("valid_from").over(order))


def decisions(best: DataFrame, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """best (one row per document; score null without a candidate) with decision, and what is stored for it. Where best has
    a column `named`, a document without a readable name goes to a person instead of being rejected. Where it has a
    column threshold_id, an id that isn't positive (the defaults) is stored as null."""
    d = decide(F.col("score"), F.col("score").isNotNull(), F.lit(upper), F.lit(lower))
    if "named" in best.columns:
        d = F.when(~F.coalesce("named", F.lit(False)), F.lit(REVIEW)).otherwise(d)
    out = best.withColumn("decision", d)
    if "threshold_id" in best.columns:
        out = out.withColumn("threshold_id", F.when(F.col("threshold_id") > 0, F.col("threshold_id")))
    return out.withColumns({
        "code": decision_code(F.col("decision")), "partner_id": F.when(F.col("decision") != REJECT, F.col("partner_id")),
        "stored_score": F.when(F.col("score") > 0, F.col("score").cast("decimal(5,2)")),
    })


def simulate(scores: DataFrame, upper: float, lower: float, by: Sequence[str] = ()) -> DataFrame:
    """How many stored scores each threshold pair would approve, send to review and reject: one pass, no re-matching."""
    s = F.col("score")
    return scores.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(s >= upper).alias("auto"), F.count_if((s >= lower) & (s < upper)).alias("review"), F.count_if(s < lower).alias("reject"),
    )


def histogram(scores: DataFrame) -> DataFrame:
    """Ten buckets of ten points, 100 in the last, empty ones with 0."""
    spark = scores.sparkSession
    counted = scores.groupBy(F.least(F.floor(F.col("score") / 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


GRID = (100, 99, 95, 90, 85, 80, 75, 70)


def sweep(judged: DataFrame, grid: Sequence[int] = GRID) -> DataFrame:
    """judged (score, correct): for each upper threshold the approved and the wrongly approved."""
    counts = [F.count_if(F.col("score") >= u).alias(f"a{u}") for u in grid] + [F.count_if((F.col("score") >= u) & ~F.col("correct")).alias(f"w{u}") for u in grid]
    row = judged.agg(*counts)
    each = F.array(*(F.struct(F.lit(int(u)).alias("upper"), F.col(f"a{u}").alias("auto"), F.col(f"w{u}").alias("wrong")) for u in grid))
    return row.select(F.explode(each).alias("g")).select("g.*")


def safest(swept: DataFrame) -> DataFrame:
    """The lowest threshold without a wrong approval."""
    return swept.where("wrong = 0").agg(F.min("upper").alias("best_upper"))


def upper_median(rows: DataFrame, by: str, score: str) -> DataFrame:
    """(by, median): the upper median of each group. Rows are first counted by value, so the running sum that places the
    middle sees each value once."""
    counted = rows.where(F.col(score).isNotNull()).groupBy(by, F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    total = counted.groupBy(by).agg(F.sum("_n").alias("_all"))
    placed = counted.withColumn("_to", F.sum("_n").over(Window.partitionBy(by).orderBy("_s"))).join(total, by)
    return placed.where(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy(by).agg(F.min("_s").alias("median"))


def score_stats(judged: DataFrame) -> DataFrame:
    """n, least, upper median, mean and greatest score of correct and incorrect matches."""
    s = F.col("score")
    out = judged.groupBy("correct").agg(F.count("*").alias("n"), F.min(s).alias("lo"), F.avg(s).alias("mean"), F.max(s).alias("hi"))
    return out.join(upper_median(judged, "correct", "score"), "correct", "left").select("correct", "n", "lo", "median", "mean", "hi")


def overlap(judged: DataFrame) -> DataFrame:
    """Correct matches that score below the best wrong one, and wrong ones at or above the least correct one."""
    edges = judged.agg(F.max(F.when(~F.col("correct"), F.col("score"))).alias("wrong_max"), F.min(F.when(F.col("correct"), F.col("score"))).alias("right_min"))
    both = judged.crossJoin(F.broadcast(edges))  # one row
    return both.agg(F.first("wrong_max").alias("wrong_max"), F.first("right_min").alias("right_min"), F.count_if(F.col("correct") & (F.col("score") < F.col("wrong_max"))).alias("right_below"), F.count_if(~F.col("correct") & (F.col("score") >= F.col("right_min"))).alias("wrong_above"))


def confusion(judged: DataFrame) -> DataFrame:
    return judged.groupBy("decision").agg(F.count_if("correct").alias("correct_n"), F.count_if(~F.col("correct")).alias("wrong_n"))


#: Weights tried by weight_sweep: edit distance, n-grams, prefix, suffix.
WEIGHT_GRID = ((0.5, 0.3, 0.1, 0.1), (0.5, 0.3, 0.2, 0.0), (0.4, 0.4, 0.1, 0.1), (0.6, 0.2, 0.1, 0.1), (0.4, 0.3, 0.15, 0.15), (0.34, 0.33, 0.33, 0.0), (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0))


def weight_sweep(pairs: DataFrame, upper: float = UPPER, lower: float = LOWER, grid: Sequence[Sequence[float]] = WEIGHT_GRID) -> DataFrame:
    """pairs: stored metrics of all candidates (query_id, partner_id, truth_id, levenshtein, jaccard, prefix, suffix).
    For each weighting: queries, right at the top, auto, review, reject, wrong auto. Nothing is matched again."""
    spark = pairs.sparkSession
    weights = spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(grid)], "weighting int, w1 double, w2 double, w3 double, w4 double")
    each = pairs.crossJoin(F.broadcast(weights))  # the grid has a handful of rows
    each = each.withColumn("score", combine(*(F.col(c) for c in ("levenshtein", "jaccard", "prefix", "suffix")), [F.col(f"w{i}") for i in range(1, 5)]))
    top = each.groupBy("weighting", "query_id").agg(F.max_by(F.struct("partner_id", "truth_id", "score"), F.struct(F.round("score", 9), -F.col("partner_id"))).alias("b")).select("weighting", "b.*")
    top = top.withColumn("decision", decide(F.col("score"), F.lit(True), F.lit(upper), F.lit(lower)))
    right = F.col("partner_id") == F.col("truth_id")
    return top.groupBy("weighting").agg(
        F.count("*").alias("n"), F.count_if(right).alias("top1"), F.count_if(F.col("decision") == AUTO).alias("auto"), F.count_if(F.col("decision") == REVIEW).alias("review"),
        F.count_if(F.col("decision") == REJECT).alias("reject"), F.count_if((F.col("decision") == AUTO) & ~right).alias("wrong_auto"),
    )


def chosen_read(reads: DataFrame) -> DataFrame:
    """reads (document_id, variant 'raw' or 'preprocessed', name, candidates): the raw read unless it gives no name or no
    candidate and the preprocessed one does; scores don't decide."""
    usable = F.coalesce((F.col("name") != "") & (F.col("candidates") > 0), F.lit(False))
    order = F.struct(usable, F.col("variant") == "raw", F.col("name").isNotNull())
    best = reads.groupBy("document_id").agg(F.max_by(F.struct("variant", "name", "candidates"), order).alias("b"))
    return best.select("document_id", "b.*")

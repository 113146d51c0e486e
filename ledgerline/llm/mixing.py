"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Every document has an exponential key, -log(u) / weight: u follows from a hash of its id, and weight is its quality.
Taken in key order, documents form a weighted random order without replacement. A source first takes as many complete
epochs of all its documents as its target holds, then documents in key order up to what is left of the target; the
document at the edge is taken in part. Where the order is cut needs no global sort: keys are counted in fixed bins,
the bin in which the edge lies is found from the bins' sums, and only documents of that bin are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, text_or_empty, wrapped

WEIGHTS = (5.0, 2.0, 1.0)
#: A document is taken at most so many times.
EPOCHS = 3
#: Bins of keys for each unit of the key: a bin holds at most 1/BINS of a source's documents of weight 1, in expectation.
BINS = 4096
NOISE = "0123456789#$%&*+<>=@[]^_{|}~"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """Weight of a document: the share of its characters that are neither digits nor signs, 0.05 at least."""
    n = F.length(text)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), F.length(F.translate(text, NOISE, "")) / n))


def key(id_: Column, weight: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def level(sizes: DataFrame) -> float:
    """The level L at which the targets min(cap, L * weight) share the whole size: capped sources keep their cap and
    the others share what is left by weight, again until none is above. One small aggregation a round."""
    total, weight = sizes.agg(F.sum("source_size"), F.sum("source_weight")).first()
    if not total:
        return 0.0
    at, before = total / weight, -1
    while True:
        over = F.col("source_size") * EPOCHS <= F.col("source_weight") * at
        n, capped, rest = sizes.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size") * EPOCHS)), F.sum(F.when(~over, F.col("source_weight")))).first()
        if n == before or not rest:
            return at
        at, before = (total - (capped or 0)) / rest, n


def plan(spark: SparkSession, docs: DataFrame, seed: int, weights: Sequence[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of docs (doc_id, text, source and others that begin with _) with _size, _key, _bin; the same without texts, written; one row per source with its target and where its order is cut)."""
    text = text_or_empty()
    rows = docs.withColumns({"_size": words(text), "_key": key(F.col("doc_id"), quality(text), seed)})
    rows = rows.withColumn("_bin", F.floor(F.col("_key") * BINS))
    small = materialise(spark, rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "_size", "_key", "_bin"), "keys")

    bins = materialise(spark, small.groupBy("source", "_bin").agg(F.sum("_size").alias("bin_size")), "bins")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # One row per source from here on.
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    place = (F.row_number().over(order) - 1) % len(weights)
    sizes = sizes.withColumn("source_weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int")))
    sizes = materialise(spark, sizes, "sizes")
    target = F.least(F.col("source_size") * float(EPOCHS), F.col("source_weight") * F.lit(level(sizes)))
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    sizes = sizes.withColumn("target", target).withColumn("epochs", whole).withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
    sizes = materialise(spark, sizes, "targets")

    up_to = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = bins.withColumn("upto", F.sum("bin_size").over(up_to))
    edge = sums.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("upto > part")
    edge = edge.groupBy("source").agg(F.min(F.struct("_bin", "bin_size", "upto")).alias("e"))
    edge = edge.select(F.col("source").alias("s"), F.col("e._bin").alias("edge_bin"), (F.col("e.upto") - F.col("e.bin_size")).alias("below"))
    edge = materialise(spark, edge, "edge_bins")

    inside = small.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("_bin") == F.col("edge_bin")))
    # Rows that repeat a doc_id have the same key and are cut alike.
    inside = inside.groupBy("source", "_key", "doc_id", "below").agg(F.sum("_size").alias("tie_size"))
    ordered = Window.partitionBy("source").orderBy(F.col("_key"), F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("below") + F.sum("tie_size").over(ordered))
    cut = inside.join(sizes.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s"))).where("upto > part")
    cut = cut.groupBy("source").agg(F.min(F.struct("_key", F.col("doc_id").isNull().alias("blank"), "doc_id", "tie_size", "upto")).alias("c"))
    cut = cut.select(F.col("source").alias("s"), F.col("c._key").alias("cut_key"), F.col("c.blank").alias("cut_blank"), F.col("c.doc_id").alias("cut_id"), "c.tie_size", (F.col("c.upto") - F.col("c.tie_size")).alias("before"))
    known = sizes.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "source_weight")
    return rows, small, materialise(spark, known.withColumnRenamed("source", "_source"), "cuts")


def joined(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with _taken. cuts has a row per source; Spark broadcasts it where it is small and splits hot sources else."""
    both = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    mine, edge = F.struct("_key", F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.struct("cut_key", "cut_blank", F.coalesce("cut_id", F.lit(0).cast("long")))
    some = F.floor(F.col("_size") * ((F.col("part") - F.col("before")) / F.col("tie_size")))
    # Without a cut all of the source is taken only if the whole of it fits; then part is 0 or no less than its size.
    none_cut = F.when(F.col("part") >= F.col("source_size"), F.col("_size")).otherwise(F.lit(0))
    share = F.when(F.col("cut_key").isNull(), none_cut).when(mine < edge, F.col("_size")).when(mine == edge, F.greatest(F.lit(0), some)).otherwise(F.lit(0))
    return both.withColumn("_taken", (F.col("epochs") * F.col("_size") + share).cast("long"))


def mix(spark: SparkSession, docs: DataFrame, seed: int = 7, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted).

    Sources in order of code points, null last, have the weights in turn; a source's target is at most EPOCHS times its
    size and the excess is shared by the others. A null or blank text has size 0 and takes nothing; a null source is a
    source. Rows that repeat a doc_id stay rows of their own with equal keys, and the edge cuts them alike. An empty
    table gives no rows; further columns are ignored whatever their names. The same rows and seed give the same result.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    _, small, cuts = plan(spark, held, seed, weights)
    return joined(small, cuts).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, seed: int = 7, weights: Sequence[float] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it; the document at a source's edge once more if at least half of it is taken."""
    own = F.col("_doc")
    held = wrapped(docs).select("_doc", own.getField(id_col).alias("doc_id"), own.getField(text_col).alias("text"), own.getField(source_col).alias("source"))
    rows, _, cuts = plan(spark, held, seed, weights)
    times = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(F.lit(0)).cast("int")
    out = joined(rows, cuts).withColumn("_times", times).where("_times > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")

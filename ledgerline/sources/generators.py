"""Seeded synthetic masters and statement descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..functions.values import drawn

#: Invented names: a head, a tail and sometimes a number.
HEADS = ["ミナト", "アオイ", "カモメ", "ツキノ", "イサミ", "ホトリ", "ソラノ", "ユキワ"]
TAILS = ["製菓", "織物", "カビン", "漆器", "倉庫", "園芸", "測量", "造船", "書房", "香料", "染色", "ガラス"]
TRUNCATIONS = [8, 12, 16, 20, 24, 0]
SEED = 7001


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def masters(spark: SparkSession, n: int = 200, seed: int = SEED) -> DataFrame:
    """partner_id, core, canonical, variants: 80 % of one legal form, 20 % of the other; 2 to 4 written variants."""
    i = F.col("id")
    core = F.concat(pick(HEADS, drawn(seed, "id")), pick(TAILS, drawn(seed + 1, "id")), F.when(i % 3 == 0, (i % 999 + 1).cast("string")).otherwise(""))
    stock = drawn(seed + 2, "id") % 10 < 8
    both = lambda full, short, sign: [F.concat(F.lit(full), "core"), F.concat("core", F.lit(full)), F.concat(F.lit(short), "core"), F.concat("core", F.lit(sign))]
    stock_forms, limited_forms = F.array(*both("株式会社", "(株)", "㈱")), F.array(*both("有限会社", "(有)", "㈲"))
    rows = spark.range(1, n + 1).withColumn("core", core).withColumn("all", F.when(stock, stock_forms).otherwise(limited_forms))
    shuffled = F.array_sort(F.transform("all", lambda v: F.struct(F.xxhash64(v, F.lit(seed)).alias("k"), v.alias("v"))))
    variants = F.slice(F.transform(shuffled, lambda s: s.v), 1, (drawn(seed + 3, "id") % 3).cast("int") + 2)
    return rows.select(i.alias("partner_id"), "core", variants.alias("variants")).withColumn("canonical", F.element_at("variants", 1))


def descriptions(partners: DataFrame) -> DataFrame:
    """Statement descriptions of each partner: five shapes, each cut to each length (0: whole); partner_id, shape, trunc, text."""
    name = normalize(F.col("canonical"))
    shapes = F.array(*(F.struct(F.lit(i).alias("shape"), t.alias("whole")) for i, t in enumerate([name, F.concat(F.lit("カ)"), name), F.concat(name, F.lit("(カ")), F.concat(F.lit("フリコミ "), name), F.concat(F.lit("フリコミ"), name)])))
    each = partners.select("partner_id", F.explode(shapes).alias("s"), F.lit(None).alias("_")).select("partner_id", "s.*")
    each = each.withColumn("trunc", F.explode(F.array(*(F.lit(t) for t in TRUNCATIONS))))
    text = F.when(F.col("trunc") == 0, F.col("whole")).otherwise(F.substr("whole", F.lit(1), F.col("trunc")))
    return each.select("partner_id", "shape", "trunc", text.alias("text"), F.length("whole").alias("full_len"), (text != F.col("whole")).alias("cut"))


# How far scans of each kind are degraded.
PRESETS = {
    "light": {"angle": 1.0, "noise": 4, "jpeg": 88, "shadow": 0.06, "bleed": 0.03, "fold": 0.3, "fade": 0.15, "blur": 0.3},
    "normal": {"angle": 2.5, "noise": 9, "jpeg": 72, "shadow": 0.14, "bleed": 0.07, "fold": 0.6, "fade": 0.30, "blur": 0.6},
    "heavy": {"angle": 4.0, "noise": 16, "jpeg": 55, "shadow": 0.24, "bleed": 0.13, "fold": 0.9, "fade": 0.50, "blur": 1.0},
}
ITEMS = ["封筒", "塗料", "木箱", "毛糸", "砂糖"]


def forms(partners: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n documents with their truth: doc_type, partner, written name, date, number, rows of items, totals, degradation."""
    spark = partners.sparkSession
    count = partners.count()
    r = lambda k: drawn(seed + k, "document_id") % 1_000_003
    docs = spark.range(1, n + 1).select(F.col("id").alias("document_id")).withColumn("partner_id", r(0) % count + 1)
    lines = F.transform(F.sequence(F.lit(1), (r(1) % 5 + 1).cast("int")), lambda i: F.struct(pick(ITEMS, r(2) + i).alias("item"), ((r(3) + i) % 20 + 1).cast("int").alias("qty"), ((r(4) * i) % 9000 + 100).cast("int").alias("unit")))
    rows = F.transform(lines, lambda x: F.struct(x.item.alias("item"), x.qty.alias("qty"), x.unit.alias("unit"), (x.qty * x.unit).alias("amount")))
    preset = pick(list(PRESETS), r(5))
    out = docs.join(partners.select("partner_id", "canonical", "variants"), "partner_id").withColumn("rows", rows)
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x.amount)
    return out.select(
        "document_id", (r(6) % 3 + 1).cast("int").alias("doc_type"), "partner_id", F.col("canonical").alias("partner_canonical"), F.element_at("variants", (r(7) % F.size("variants") + 1).cast("int")).alias("partner_name"),
        F.date_add(F.to_date(F.lit("2026-01-01")), (r(8) % 365).cast("int")).alias("issue_date"), F.format_string("INV-%04d", F.col("document_id")).alias("doc_no"), "rows", total.alias("total"), (total + F.floor(total * 0.1)).alias("total_with_tax"),
        preset.alias("preset"), (degradation(preset, "angle") * (r(9) / 500_001.5 - 1)).alias("angle"), degradation(preset, "blur").alias("blur"), degradation(preset, "noise").cast("int").alias("noise"),
        degradation(preset, "jpeg").cast("int").alias("jpeg_quality"), degradation(preset, "shadow").alias("shadow"), degradation(preset, "bleed").alias("bleed"), (r(10) / 1_000_003 < degradation(preset, "fold")).alias("fold"), degradation(preset, "fade").alias("fade"),
    )


def degradation(preset: Column, what: str) -> Column:
    out = F.lit(None).cast("double")
    for k, v in PRESETS.items():
        out = F.when(preset == k, F.lit(float(v[what]))).otherwise(out)
    return out

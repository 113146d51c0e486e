"""Words and neighbours of lines, against the column functions."""

from pyspark.sql import functions as F

from ledgerline.functions import text, values
from ledgerline.operators import extract

TEXTS = ["株式会社サンプル 代表", "取締役", "登録番号 T1", "ＴＥＬ 03", "ミホン様", "合計金額", "No. 3", "No", "¥5", "\\5", "5円", "千代田区", "青葉会", "ＦＡＸ（㈱", "小計", "", "請求書　御中"]
DATES = ["2024-1-2", "２０２４年１月２日", "2024 / 1 / 2", "令和6.1.2", "R6ー1−2", "T 6", "12円-", "2024年", "x", "", "2024\t-1-2", "発行日 2024/02/30", "Ｒ６年１月２日 令和5年1月1日", "2024.1.2-R6"]


def test_kinds_equal_column_functions(spark):
    """extract_fields looked for words in every line once for every other line of its page."""
    want = {
        "corporate": text.has_corporate, "title": text.looks_like_title, "contact": text.looks_like_contact, "address": text.looks_like_address, "label": text.looks_like_label, "to": lambda s: text.any_of(s, extract.HONORIFICS),
        "labelled": lambda s: text.any_of(s, text.REG_LABELS), "totals": lambda s: text.any_of(s, extract.TOTALS), "numbers": lambda s: text.any_of(s, extract.NUMBERS), "money": lambda s: text.any_of(s, ["¥", "\\", "円"]),
    }
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", *(f(F.col("t")).alias(k) for k, f in want.items())).collect()
    for r in rows:
        assert {k: bool(extract.text_kinds(r.t) & extract.BIT[k]) for k in want} == {k: r[k] for k in want}, r.t
    blocks = spark.createDataFrame([(1, 0, "x", 0.9, 0, 0, 5, 5)], "document_id long, seq int, text string, confidence double, x int, y int, w int, h int")
    assert "all" not in extract.lines(blocks).columns  # no line carries its page


def test_patterns_are_tried_where_they_can_match(spark):
    blocks = spark.createDataFrame([(i, 0, t, 0.9, 0, 0, 50, 10) for i, t in enumerate(DATES)], "document_id long, seq int, text string, confidence double, x int, y int, w int, h int")
    got = {r.document_id: r.value for r in extract.extract_fields(blocks).where("field_key = 'issue_date'").collect()}
    want = spark.createDataFrame(list(enumerate(DATES)), "i long, t string").select("i", values.recognised_date(F.col("t")).alias("d")).where("d != ''").collect()
    assert got == {r.i: r.d for r in want} and len(got) > 5

"""Golden values of the row functions."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import similarity, text, values

from .helpers import evaluate

# SAME, BANK, SCORES and SETTLED, which must come out as they are here.
SAME = [
    ["株式会社ヤマト商事", "ヤマト商事株式会社", "(株)ヤマト商事", "ヤマト商事(株)", "㈱ヤマト商事", "ヤマト商事㈱", "ヤマト商事"], ["有限会社サクラ工業", "サクラ工業有限会社", "(有)サクラ工業", "㈲サクラ工業", "サクラ工業"],
    ["ＡＢＣ商事", "ABC商事", "ａｂｃ商事", "abc商事"], ["ヤマト 商事", "ヤマト　商事", "ヤマト商事"], ["ヤマト・商事", "ヤマト-商事", "ヤマト＆商事"], ["やまと商事", "ヤマト商事", "ﾔﾏﾄ商事"], ["ﾊﾞﾝﾀﾞｲ", "バンダイ"], ["ﾊﾟﾝ工房", "パン工房"],
    ["髙島商事", "高島商事"], ["山﨑物産", "山崎物産"], ["渡邊工業", "渡辺工業"], ["櫻井商会", "桜井商会"], ["株式株式会社会社ヤマト", "ヤマト"], ["ｳﾞｨﾗ", "ヴィラ"],
]
BANK = {"ｶ)ﾐﾗｲﾊｲｿｳｻｰﾋﾞｽ": "ミライハイソウサービス", "ﾐﾎﾝｾｷﾕｻｰﾋﾞｽ(ｶ": "ミホンセキユサービス", "ﾕ)ﾔﾏﾄｳﾝﾕ": "ヤマトウンユ", "ﾌﾘｺﾐ ｶ)ｻﾝﾌﾟﾙｼｮｳｼﾞ": "サンプルショウジ", "ﾃﾞﾋﾞｯﾄ ｻﾝﾌﾟﾙﾏｰﾄ": "サンプルマート", "シャ)ケンショウカイ": "ケンショウカイ", "ﾀｶﾗﾂｶｴｷﾏｴｼｮｳｼﾞ": "タカラツカエキマエショウジ"}


def test_names_that_are_the_same(spark):
    flat = [(n,) for group in SAME for n in group]
    got = iter(evaluate(spark, text.normalize, flat, "a string"))
    for group in SAME:
        assert len({next(got) for _ in group}) == 1, group


def test_names_that_differ(spark):
    pairs = [("ヤマト運輸", "ヤマト建設"), ("ヤマト商事", "ヤマダ商事"), ("東京商事", "京東商事")]
    assert all(evaluate(spark, lambda a, b: text.normalize(a) != text.normalize(b), pairs, "a string, b string"))


def test_bank_names(spark):
    assert evaluate(spark, lambda a: text.normalize(a, bank=True), [(k,) for k in BANK], "a string") == list(BANK.values())
    assert evaluate(spark, text.normalize, [("カ)ミライハイソウサービス",)], "a string") == ["カ)ミライハイソウサービス"]


def test_grams(spark):
    assert evaluate(spark, text.ngrams, [("ヤマト商事",), ("ヤ",), ("",)], "a string") == [["ヤマ", "マト", "ト商", "商事"], ["ヤ"], []]
    assert evaluate(spark, lambda a: F.size(text.trigrams(a)), [("シラカワ商事",), ("",)], "a string") == [7, 0]


SCORES = [("コウヨウエ業", "コウヨウ産業", 62.86, 67.86), ("バハルタ商事87", "ハルタ商事87", 78.21, 69.46), ("ミホンインサツ", "ミホンインサツコウギョウ", 51.36, 57.20), ("ヤマト運輸", "ヤマト建設", 46.0, 52.0), ("ヤマト商事", "ヤマダ商事", 58.0, 58.0), ("", "", 80.0, 80.0), ("ヤマト", "", 0.0, 0.0), ("ヤマト", "ヤマト", 100.0, 100.0)]


def scored(weights):
    return lambda a, b: F.round(similarity.combine(similarity.levenshtein_sim(a, b), similarity.jaccard_sim(text.ngrams(a), text.ngrams(b)), similarity.prefix_sim(a, b), similarity.suffix_sim(a, b), weights), 2)


def test_scores(spark):
    pairs = [s[:2] for s in SCORES]
    assert evaluate(spark, scored(similarity.WEIGHTS), pairs, "a string, b string") == [s[2] for s in SCORES]
    assert evaluate(spark, scored((0.5, 0.3, 0.2, 0.0)), pairs, "a string, b string") == [s[3] for s in SCORES]
    assert evaluate(spark, scored((0, 0, 0, 0)), pairs[:1], "a string, b string") == [0.0]


def test_decisions(spark):
    rows = [(100.0, 95.0, 70.0), (95.0, 95.0, 70.0), (94.9, 95.0, 70.0), (70.0, 95.0, 70.0), (69.9, 95.0, 70.0), (0.0, 95.0, 70.0), (None, 0.0, 0.0), (62.9, 95.0, 55.0), (50.9, 95.0, 55.0)]
    assert evaluate(spark, lambda s, u, lo: values.decide(s, s.isNotNull(), u, lo), rows, "a double, b double, c double") == [1, 1, 2, 2, 3, 3, 3, 2, 3]


def test_registration_numbers(spark):
    good = ["9234567890123", "1345678901234", "2901234567890", "3456789012345", "4567890123456", "6012345678901", "6678901234567", "7123456789012", "7789012345678", "9890123456789"]
    rows = [(g,) for g in [*good, "1234567890123"]]
    assert evaluate(spark, values.check_digit_ok, rows, "a string") == [True] * 10 + [False]
    raw = ["Ｔ９２３４５６７８９０１２３", "登録番号 T9234-5678-90123", "t 9234 5678 90123"]
    assert evaluate(spark, values.reg_no, [(r,) for r in raw], "a string") == ["T9234567890123"] * 3
    assert evaluate(spark, values.reg_status, [("",), ("  ",), (None,), ("T123456789012",), ("T12345678901234",), ("9234567890123",), ("T1234567890123",), ("T9234567890123",)], "a string") == [1, 1, 1, 2, 2, 2, 3, 4]


def test_every_changed_digit_is_caught_but_nought_for_nine(spark):
    n = "9234567890123"
    changed = [n[:i] + d + n[i + 1 :] for i in range(13) for d in "0123456789" if d != n[i]]
    ok = evaluate(spark, values.check_digit_ok, [(c,) for c in changed], "a string")
    assert len(changed) == 117 and sum(not x for x in ok) == 115
    assert all({a, b} == {"0", "9"} for c, x in zip(changed, ok, strict=True) if x for a, b in zip(c, n, strict=True) if a != b)


def test_numbers_in_lines(spark):
    assert evaluate(spark, text.find_reg_no, [("TEL 049-999-0001 T9234-5678 90123",), ("T12",)], "a string") == ["T9234567890123", ""]
    assert evaluate(spark, text.find_reg_no_loose, [("登録番号 T923456789012",), ("登録番号 9234567890123",), ("登録 123",), ("登録番号 T12345678901234",)], "a string") == ["T923456789012", "9234567890123", "", "T12345678901234"]


def test_dates_and_amounts(spark):
    assert [str(d) if d else None for d in evaluate(spark, values.ledger_date, [("2026/07/15",), ("2026-07-15",), ("2026年7月15日",), ("20260715",), ("繰越",), ("2026/02/31",)], "a string")] == ["2026-07-15"] * 4 + [None] * 2
    assert evaluate(spark, values.recognised_amount, [("¥882,090-",), ("882,090-00",), ("376,750-8",), ("-12",), ("1234567890123",), ("",)], "a string") == [882090, 882090, 376750, -1, -1, -1]
    assert evaluate(spark, values.recognised_date, [("R8.8.10",), ("令和８年８月１０日",), ("発行日 2026年5月25日",), ("2026/13/01",), ("",)], "a string") == ["2026-08-10", "2026-08-10", "2026-05-25", "", ""]
    assert evaluate(spark, values.ledger_amount, [("1,258",), ("-５００",), ("▲30",), ("",), (None,)], "a string") == [1258, -500, -30, 0, 0]


SETTLED = [
    (44352, "2026-07-31", 44352, "2026-08-25", 1, 36.4, 100, 100, 74.56), (44352, "2026-07-31", 44352, "2026-08-25", 1, 100.0, 100, 100, 100.0), (175010, "2026-07-31", 174570, "2026-08-25", 1, 100.0, 70, 100, 89.5),
    (1258, "2026-07-15", 1038, "2026-07-15", 2, 100.0, 0, 100, 65.0), (1258, "2026-07-15", 1258, "2026-07-15", 2, 100.0, 100, 100, 100.0), (1258, "2026-07-15", 1258, "2026-07-17", 2, 100.0, 100, 80, 95.0),
    (1258, "2026-07-15", 1258, "2026-08-20", 2, 100.0, 100, 30, 82.5), (5000, None, 5000, "2026-07-15", 1, 100.0, 100, 50, 87.5), (10000, "2026-07-01", 10000, "2026-07-20", 1, 10.0, 100, 100, 64.0),
]


def test_settlement_scores(spark):
    rows = [r[:6] for r in SETTLED]
    schema = "a long, b string, c long, d string, e int, f double"
    assert evaluate(spark, lambda a, b, c, d, e, f: values.amount_score(a, c, e), rows, schema) == [float(r[6]) for r in SETTLED]
    assert evaluate(spark, lambda a, b, c, d, e, f: values.date_score(F.to_date(b), F.to_date(d), e), rows, schema) == [float(r[7]) for r in SETTLED]
    whole = lambda a, b, c, d, e, f: values.settle_score(f, values.amount_score(a, c, e), values.date_score(F.to_date(b), F.to_date(d), e))
    assert evaluate(spark, whole, rows, schema) == pytest.approx([r[8] for r in SETTLED])
    assert evaluate(spark, lambda a: values.settle_score(a, F.lit(100.0), F.lit(80.0)) >= 95, [(100.0,)], "a double") == [True]


def test_caps(spark):
    rows = [(95.0, 55.0), (92.0, 55.0), (90.0, 55.0), (85.0, 55.0), (70.0, 40.0), (95.0, 70.0), (80.0, 55.0), (75.0, 50.0)]
    assert evaluate(spark, values.name_cap, rows, "a double, b double") == pytest.approx([80, 77.5, 72.5, 60.0, 22.5, None, None, None])


def test_billing(spark):
    rows = [(False, "past_due", 10, 9), (False, "past_due", 10, 10), (False, "strange", None, 0), (True, None, None, 0), (False, None, None, 0), (False, "canceled", None, 0), (False, "unpaid", None, 0)]
    at = lambda c: F.timestamp_seconds(c)
    assert evaluate(spark, lambda e, s, g, n: values.billing_allowed(e, s, at(g), at(n)), rows, "a boolean, b string, c long, d long") == [True, False, True, True, False, False, False]


def test_names_are_tidied(spark):
    assert evaluate(spark, text.tidy_name, [("ヤマト運輸335(株)御』of",), ("ABC商事様",), ("ヤマト(株)ab",), ("ABC Ltd",)], "a string") == ["ヤマト運輸335(株)", "ABC商事", "ヤマト(株)", "ABC Ltd"]


def test_unknown_decisions_fail(spark):
    with pytest.raises(Exception, match="unknown decision"):
        evaluate(spark, values.decision_action, [(9,)], "a int")


def test_white_space_of_any_kind_is_stripped_from_ledger_cells(spark):
    cells = [("\t-500",), ("　-1,500 ",), ("\u00a0▲20",), ("　７８９",), ("9223372036854775807",), ("9223372036854775808",), (" \u2003 ",), (None,), ("1-2",)]
    assert evaluate(spark, values.ledger_amount, cells, "a string") == [-500, -1500, -20, 789, 9223372036854775807, 0, 0, 0, 12]
    days = [("　2026/7/5",), ("\t20260705 ",), ("2026年7月5日\u3000",), ("2026/13/1",), ("　",)]
    assert [str(v) for v in evaluate(spark, values.ledger_date, days, "a string")] == ["2026-07-05"] * 3 + ["None"] * 2


def test_common_prefixes(spark):
    pairs = [("abc", "abd"), ("abc", "abc"), ("a", "b"), ("", "a"), ("aab", "aa"), ("a\nb", "a\nc"), ("aa", "aaa"), ("x\0y", "x\0z")]
    assert evaluate(spark, lambda a, b: F.round(similarity.prefix_sim(a, b), 4), pairs, "a string, b string") == [0.6667, 1.0, 0.0, 0.0, 0.6667, 0.6667, 0.6667, 0.6667]

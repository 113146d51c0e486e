"""Column functions on names and recognised text: normalisation, n-grams, lexical tests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms with their kind, most bytes first.
CORP_FORMS = [
    ("特定非営利活動法人", "other"), ("一般社団法人", "other"), ("公益社団法人", "other"), ("一般財団法人", "other"), ("公益財団法人", "other"), ("社会福祉法人", "other"),
    ("株式会社", "kabushiki"), ("有限会社", "yugen"), ("合同会社", "godo"), ("合資会社", "other"), ("合名会社", "other"), ("医療法人", "other"), ("学校法人", "other"), ("宗教法人", "other"),
    ("（株）", "kabushiki"), ("（有）", "yugen"), ("NPO法人", "other"), ("(株)", "kabushiki"), ("(有)", "yugen"), ("(同)", "godo"), ("㈱", "kabushiki"), ("㈲", "yugen"),
]
# Half-width katakana from U+FF66 on and what they stand for.
HALF_KANA = "ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ"
FULL_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
# Old forms of kanji and today's.
OLD_KANJI, NEW_KANJI = "髙﨑濵嶋嶌邊邉龍櫻國學澤齋藝圓驛", "高崎浜島島辺辺竜桜国学沢斎芸円駅"
# Signs and white space that names do without.
SIGNS = "・.．-－‐−'’\"”&＆·"
SPACES = " 　\t\n\r"
# Abbreviations of legal forms in bank statements, in the order in which they are tried, and words before names.
BANK_FORMS = ["トクヒ", "シュウ", "ザイ", "シャ", "ガク", "フク", "イリョウ", "カ", "ユ", "ド", "メ", "シ", "ソ"]
BANK_WORDS = ["フリコミ", "フリカエ", "デビット"]
# Voiced kana and their voiceless forms.
VOICED, VOICELESS = "ガギグゲゴザジズゼゾダヂヅデドバビブベボパピプペポヴ", "カキクケコサシスセソタチツテトハヒフヘホハヒフヘホウ"

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))


def voiced_pairs() -> list[tuple[str, str]]:
    """Half-width kana with a voicing mark and the one kana they make: one code point on (ﾞ) or two (ﾟ), except ヴ."""
    out = []
    for half, full in zip(HALF_KANA, FULL_KANA, strict=True):
        out.append((half + "ﾞ", "ヴ" if full == "ウ" else chr(ord(full) + 1)))
        out.append((half + "ﾟ", chr(ord(full) + 2)))
    return out


def words_of(words: list[str]) -> Column:
    """A constant array of words without bars."""
    return F.split(F.lit("|".join(words)), "[|]")


def without_forms(s: Column) -> Column:
    """Every legal form removed anywhere, the longest first, until none is left."""
    tokens = words_of([t for t, _ in CORP_FORMS])
    often = lambda acc, t: F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(acc) / F.length(t)).cast("int")))
    erased = F.aggregate(tokens, s, lambda acc, t: F.aggregate(often(acc, t), acc, lambda a, _: F.replace(a, t, F.lit(""))))
    return F.when(s.rlike("株|有|㈱|㈲|同|合|法人"), erased).otherwise(s)


def widened(s: Column) -> Column:
    """Full-width signs to ASCII, half-width kana to full-width with their voicing marks."""
    pairs = words_of([a + b for a, b in voiced_pairs()])
    merged = F.aggregate(pairs, s, lambda acc, p: F.replace(acc, F.substring(p, 1, 2), F.substring(p, 3, 1)))
    return F.translate(F.when(s.rlike("[ﾞﾟ]"), merged).otherwise(s), WIDE + HALF_KANA, NARROW + FULL_KANA)


def normalize(s: Column, bank: bool = False, choon: bool = False) -> Column:
    """The comparable form of a company name. bank: statement abbreviations are taken off too; choon: ー and ッ levelled."""
    out = F.translate(widened(without_forms(s)), SPACES + SIGNS, "")
    out = F.translate(out, HIRAGANA + OLD_KANJI, KATAKANA + NEW_KANJI)
    if choon:
        out = F.translate(out, "ッー", "ツ")
    out = F.translate(out, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return without_bank_tokens(out) if bank else out


def without_bank_tokens(s: Column) -> Column:
    forms = "|".join(BANK_FORMS)
    s = F.regexp_replace(s, f"^(?:{'|'.join(BANK_WORDS)})+", "")
    s = F.regexp_replace(s, rf"^(?:{forms})\)", "")
    return F.regexp_replace(s, rf"\((?:{forms})$", "")


def corp_kind(s: Column) -> Column:
    out = F.lit("none")
    for token, kind in reversed(CORP_FORMS):
        out = F.when(s.contains(token), F.lit(kind)).otherwise(out)
    return out


def ngrams(s: Column, n: int = 2) -> Column:
    """All windows of n characters, repeats included; a shorter string is its only one, an empty string has none."""
    windows = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n)))
    return F.when(F.length(s) >= n, windows).when(F.length(s) > 0, F.array(s)).otherwise(F.array().cast("array<string>"))


def trigrams(s: Column) -> Column:
    """Distinct trigrams of each word in lower case, padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def strip_voicing(s: Column) -> Column:
    return F.translate(s, VOICED, VOICELESS)


def ascii_fold(s: Column) -> Column:
    return F.translate(s, WIDE + "ー−‐", NARROW + "---")


def tidy_name(s: Column) -> Column:
    """A name cut at the first honorific; trailing ASCII letters go where the rest is not all ASCII."""
    cut = F.regexp_replace(F.regexp_replace(s, "(?s)御.*$", ""), "(?s)様.*$", "")
    return F.when(cut.rlike(r"[^\x00-\x7F]"), F.regexp_replace(cut, "[A-Za-z]+$", "")).otherwise(cut)


# Words that mark kinds of lines on documents.
CORPORATE = ["株式会社", "(株)", "㈱", "有限会社", "(有)", "㈲", "合同会社", "合資会社", "合名会社"]
TITLES = ["代表", "取締役", "社長", "専務", "常務", "部長", "課長", "係長", "主任", "担当", "経理部", "総務部", "総務課", "経理課", "管理本部", "営業部", "購買部", "御担当"]
CONTACTS = ["〒", "TEL", "Tel", "tel", "FAX", "Fax", "fax", "電話", "登録番号", "振込", "口座", "銀行"]
ADDRESSES = ["都", "道", "府", "県", "市", "区", "町", "村", "丁目", "番地"]
LABELS = ["合計", "小計", "消費税", "請求書", "納品書", "領収書", "品目", "数量", "単価", "金額", "備考", "振込", "お振込先", "御請求", "上記", "レシート", "領収証", "お預り", "お釣り", "対象", "内訳"]
REG_LABELS = ["登録番号", "登録", "インボイス", "適格"]


def any_of(s: Column, words: list[str]) -> Column:
    return s.rlike("|".join(map(re.escape, words)))


def has_corporate(s: Column) -> Column:
    return any_of(s, CORPORATE)


def looks_like_title(s: Column) -> Column:
    return ~has_corporate(s) & any_of(s, TITLES)


def looks_like_contact(s: Column) -> Column:
    return any_of(ascii_fold(s), CONTACTS)


def looks_like_address(s: Column) -> Column:
    return any_of(s, ADDRESSES)


def looks_like_label(s: Column) -> Column:
    return any_of(s, LABELS)


def looks_numeric(s: Column) -> Column:
    return ascii_fold(s).rlike(r"^[0-9,.\- \\/:()¥円年月日]*$")


def looks_like_doc_no(s: Column) -> Column:
    t = ascii_fold(s)
    return t.rlike(r"^[A-Za-z0-9\-_ ]*$") & (F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) >= 4)


def find_reg_no(s: Column) -> Column:
    """T and the 13 digits after it, blanks and hyphens passed over; empty if there are none."""
    digits = F.regexp_replace(F.regexp_extract(ascii_fold(s), r"[Tt]((?:[- ]*[0-9]){13})", 1), "[- ]", "")
    return F.when(digits != "", F.concat(F.lit("T"), digits)).otherwise(F.lit(""))


def find_reg_no_loose(s: Column) -> Column:
    """For lines that name the number: the longest run of 8 digits or more after a T (all of them, so that too many show),
    else the longest run of 10 or more."""
    t = ascii_fold(s)
    pick = lambda found: F.array_max(F.transform(found, lambda d, i: F.struct(F.length(d).alias("n"), (-i).alias("i"), d.alias("d")))).d
    runs = lambda pattern, group: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda d: F.regexp_replace(d, "[- ]", ""))
    marked = pick(F.filter(runs(r"[Tt]((?:[- ]*[0-9])+)", 1), lambda d: F.length(d) >= 8))
    bare = pick(F.filter(runs(r"[0-9](?:[- ]*[0-9])*", 0), lambda d: F.length(d) >= 10))
    return F.coalesce(F.concat(F.lit("T"), marked), bare, F.lit(""))

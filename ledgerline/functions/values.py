"""Column functions on dates, amounts, registration numbers, decisions and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_fold

WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
UPPER, LOWER = 95.0, 55.0


# Dates and amounts

def drawn(seed: int, *cols: str) -> Column:
    """A number below 2**60 that follows from the seed and the columns, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols))), 1, 15), 16, 10).cast("long")


def stripped(s: Column) -> Column:
    """s without white space of any kind at its ends, wide blanks and tabs included."""
    return F.regexp_replace(s, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def ledger_date(s: Column) -> Column:
    """Dates of statements; null where there is none or the calendar has no such day."""
    t = F.replace(F.translate(stripped(s), "年月-.", "////"), F.lit("日"), F.lit(""))
    parts = F.regexp_extract(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 0)
    return F.coalesce(F.try_to_date(F.nullif(parts, F.lit("")), "yyyy/M/d"), F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")))


def ledger_amount(s: Column) -> Column:
    """Digits of either width; negative after - or ▲ at the start; 0 where there are none or more than a long holds."""
    t = stripped(F.coalesce(s, F.lit("")))
    digits = F.regexp_replace(F.translate(t, WIDE_DIGITS, DIGITS), "[^0-9]", "")
    n = F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))
    return F.when(t.startswith("-") | t.startswith("▲"), -n).otherwise(n)


def ledger_amount_unsigned(s: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), ledger_amount(s))


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """yyyy-mm-dd within 1900 to 2200, months to 12 and days to 31; empty otherwise."""
    ok = y.between(1900, 2200) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))).otherwise(F.lit(""))


def recognised_date(s: Column) -> Column:
    """The first date in recognised text as yyyy-mm-dd, Reiwa years too; empty if none."""
    t = F.translate(ascii_fold(s), "年月日/.", "-----")
    era = t.contains("令和") | t.contains("R")
    t = F.when(t.contains("令和"), F.regexp_replace(t, "^(.*?)令和", "$1W")).when(era, F.regexp_replace(t, "^(.*?)R", "$1W")).otherwise(t)
    reiwa, plain = r"W\s*([0-9]{1,2})\s*-\s*([0-9]{1,2})\s*-\s*([0-9]{1,2})", r"([0-9]{4})\s*-\s*([0-9]{1,2})\s*-\s*([0-9]{1,2})"
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    in_era = era & (F.regexp_extract(t, reiwa, 0) != "")
    return F.when(in_era, iso_date(part(reiwa, 1) + 2018, part(reiwa, 2), part(reiwa, 3))).otherwise(F.coalesce(iso_date(part(plain, 1), part(plain, 2), part(plain, 3)), F.lit("")))


def with_recognised_date(df: DataFrame, name: str, folded: Column, likely: Column) -> DataFrame:
    """df with recognised_date() of the text whose ascii_fold() is `folded`, in steps, so that none is computed again for each
    of its uses; empty where it is not likely."""
    df = df.withColumn("_text", F.when(likely, F.translate(folded, "年月日/.", "-----")))
    t = F.col("_text")
    df = df.withColumn("_text", F.when(t.contains("令和"), F.regexp_replace(t, "^(.*?)令和", "$1W")).when(t.contains("R"), F.regexp_replace(t, "^(.*?)R", "$1W")).otherwise(t)).withColumn("_era", likely & (folded.contains("令和") | folded.contains("R")))
    reiwa, plain = r"W\s*([0-9]{1,2})\s*-\s*([0-9]{1,2})\s*-\s*([0-9]{1,2})", r"([0-9]{4})\s*-\s*([0-9]{1,2})\s*-\s*([0-9]{1,2})"
    df = df.withColumn("_found", F.when(F.col("_era"), F.nullif(F.regexp_extract(t, reiwa, 0), F.lit("")))).withColumn("_era", F.col("_found").isNotNull())
    df = df.withColumn("_found", F.coalesce("_found", F.regexp_extract(t, plain, 0))).withColumn("_parts", F.when(F.col("_found") != "", F.regexp_extract_all("_found", F.lit("[0-9]+"), F.lit(0))))
    part = lambda i: F.try_element_at("_parts", F.lit(i)).try_cast("int")
    df = df.withColumns({"_y": part(1) + F.when(F.col("_era"), 2018).otherwise(0), "_m": part(2), "_d": part(3)})
    return df.withColumn(name, F.coalesce(iso_date(F.col("_y"), F.col("_m"), F.col("_d")), F.lit(""))).drop("_text", "_era", "_found", "_parts", "_y", "_m", "_d")


def recognised_amount(s: Column, folded: Column | None = None) -> Column:
    """An amount in recognised text: up to the first hyphen after a digit, 3 to 12 digits; -1 otherwise. folded: ascii_fold(s), where known."""
    t = F.regexp_replace(ascii_fold(s) if folded is None else folded, r"(?s)^([^0-9]*[0-9][^-]*)-.*$", "$1")
    d = F.regexp_replace(t, "[^0-9]", "")
    return F.when(F.length(d).between(3, 12), d.try_cast("long")).otherwise(F.lit(-1).cast("long"))


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / total, 1))


# Registration numbers

def reg_no(s: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), "tＴｔ" + WIDE_DIGITS, "TTT" + DIGITS), "[^T0-9]", "")


def check_digit_ok(digits13: Column) -> Column:
    """Whether the first of 13 digits is 9 less the weighted sum of the others modulo 9 (weights 1, 2, 1, .. from the right)."""
    total = F.lit(0)
    for i in range(1, 13):
        total = total + F.substring(digits13, 14 - i, 1).try_cast("int") * (1 if i % 2 else 2)
    return F.substring(digits13, 1, 1).try_cast("int") == 9 - total % 9


MISSING, BAD_FORMAT, BAD_CHECK, FORMAT_OK, FOUND, NOT_FOUND = 1, 2, 3, 4, 5, 6


def reg_status(s: Column) -> Column:
    """1 missing, 2 not T and 13 digits, 3 wrong check digit, 4 well-formed."""
    n = reg_no(s)
    return (
        F.when(n == "", F.lit(MISSING)).when(~n.rlike("^T[0-9]{13}$"), F.lit(BAD_FORMAT))
        .when(~check_digit_ok(F.substring(n, 2, 13)), F.lit(BAD_CHECK)).otherwise(F.lit(FORMAT_OK))
    )


def reg_why(status: Column, number: Column | None = None) -> Column:
    """The reason of a registration status; with the number as read, what its format lacks."""
    texts = {
        1: "no registration number could be read: there is none, or reading failed", 2: "not T and 13 digits", 3: "the check digit of a corporate number doesn't fit: misread, or the number of a sole proprietor",
        4: "well-formed; whether it exists is for the public register to say", 5: "in the public register", 6: "not in the register or revoked",
    }
    out = label(status, texts)
    if number is None:
        return out
    n = reg_no(number)
    lacks = F.when(~n.startswith("T"), F.lit("a registration number begins with T")).otherwise(F.format_string("T is followed by 13 digits; %d were read", F.length(n) - 1))
    return F.when(status == BAD_FORMAT, lacks).otherwise(out)


def reg_lookup(found: Column, revoked: Column) -> Column:
    return F.when(~F.coalesce(found, F.lit(False)) | F.coalesce(revoked, F.lit(False)), F.lit(NOT_FOUND)).otherwise(F.lit(FOUND))


def reg_needs_attention(status: Column) -> Column:
    return ~status.isin(FORMAT_OK, FOUND)


# Matching decisions

AUTO, REVIEW, REJECT = 1, 2, 3


def decide(score: Column, has: Column, upper: Column, lower: Column) -> Column:
    return F.when(~has, F.lit(REJECT)).when(score >= upper, F.lit(AUTO)).when(score >= lower, F.lit(REVIEW)).otherwise(F.lit(REJECT))


def decision_code(decision: Column) -> Column:
    """Stored codes: 1 auto, 5 for review, 4 rejected."""
    return F.when(decision == AUTO, F.lit(1)).when(decision == REVIEW, F.lit(5)).when(decision == REJECT, F.lit(4)).otherwise(F.raise_error(F.lit("unknown decision")).cast("int"))


def decision_action(code: Column) -> Column:
    names = {1: "auto_approve", 2: "approve", 3: "correct", 4: "reject", 5: "needs_review"}
    out = F.raise_error(F.concat(F.lit("unknown decision "), code.cast("string"))).cast("string")
    for k, v in names.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def document_status(code: Column, human: Column) -> Column:
    """5 done, 4 waiting for a person, 9 rejected by one."""
    return F.when(human & (code == 4), F.lit(9)).when(human | (code == 1), F.lit(5)).otherwise(F.lit(4))


def name_field(direction: Column) -> Column:
    return F.when(direction == 2, F.lit("recipient_name")).otherwise(F.lit("issuer_name"))


def decide_why(decision: Column, score: Column, upper: Column, lower: Column, named: Column | None = None) -> Column:
    """The reason of a decision in words. named: whether the document has a readable name; without one a person has to look."""
    out = (
        F.when(score.isNull(), F.lit("no candidate was found"))
        .when(decision == AUTO, F.format_string("score %.1f is at least %.1f", score, upper))
        .when(decision == REVIEW, F.format_string("score %.1f lies between %.1f and %.1f", score, lower, upper))
        .otherwise(F.format_string("score %.1f is below %.1f", score, lower))
    )
    return out if named is None else F.when(~named, F.lit("no name could be read, so nothing was matched")).otherwise(out)


# Settlement

BANK, CARD = 1, 2
FEE = 880
W_NAME, W_AMOUNT, W_DATE = 0.40, 0.35, 0.25


def amount_score(total: Column, amount: Column, source: Column) -> Column:
    diff = total - amount
    return F.when(diff == 0, F.lit(100.0)).when((source == BANK) & (diff > 0) & (diff <= FEE), F.lit(70.0)).otherwise(F.lit(0.0))


def date_score(issued: Column, paid: Column, source: Column) -> Column:
    days = F.datediff(paid, issued)
    card = F.when(days == 0, 100.0).when(days.between(1, 3), 80.0).otherwise(30.0)
    bank = F.when(days.between(0, 45), 100.0).when(days.between(46, 75), 80.0).when(days.between(-5, -1), 60.0).otherwise(30.0)
    return F.when(issued.isNull(), F.lit(50.0)).when(source == CARD, card).otherwise(bank)


def settle_score(name: Column, amount: Column, date: Column) -> Column:
    return F.lit(W_NAME) * name + F.lit(W_AMOUNT) * amount + F.lit(W_DATE) * date


def settle_notes(total: Column, amount: Column, source: Column, issued: Column, paid: Column) -> Column:
    """What is notable about a candidate: a fee kept back, an unreadable date, a payment before the document's date."""
    diff, days = total - amount, F.datediff(paid, issued)
    return F.concat_ws(
        "; ", F.when(diff == 0, None).when((source == BANK) & (diff > 0) & (diff <= FEE), F.format_string("%d less may be the transfer fee", diff)).otherwise(F.lit("the amount differs")),
        F.when(issued.isNull(), F.lit("the document's date is unreadable")).when((source != CARD) & days.between(-5, -1), F.lit("paid before the document's date, perhaps in advance")),
    )


def ambiguity_why(n_names: Column, names: Column) -> Column:
    return F.format_string("the description is cut off and fits %d partners: %s", n_names, names)


def settle_why(status: Column, score: Column, name: Column, amount: Column, date: Column, upper: Column, lower: Column, notes: Column | None = None, ambiguity: Column | None = None, forced: Column | None = None) -> Column:
    """The reason of a settlement in words; status 1 auto, 3 review, 4 none. notes and ambiguity of the best candidate are
    told where a person has to look, notes also where it is settled; forced: an ambiguity that no cap could hold."""
    parts = F.format_string("score %.1f (name %.0f, amount %.0f, date %.0f)", score, name, amount, date)
    notes, ambiguity, forced = (F.lit(x) if x is None else x for x in (notes, ambiguity, forced))
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return (
        F.when(score.isNull(), F.lit("no transaction in the range of amount and date: paid in cash, or its statement isn't imported yet"))
        .when((status == 3) & F.coalesce(forced.cast("boolean"), F.lit(False)), F.concat_ws(". ", parts, blank(ambiguity)))
        .when(status == 1, F.concat_ws(". ", F.concat(parts, F.format_string(" is at least %.0f", upper)), blank(notes)))
        .when(status == 3, F.concat_ws(". ", F.concat(parts, F.lit(" needs a person")), blank(notes), blank(ambiguity)))
        .otherwise(F.format_string("the best score %.1f is below %.0f: probably not its transaction", score, lower))
    )


def name_cap(upper: Column, lower: Column) -> Column:
    """The most that an ambiguous name may score so that the whole stays between the thresholds; null where nothing does."""
    ceiling = (upper - F.lit(W_AMOUNT) * 100 - F.lit(W_DATE) * 100 - 1) / F.lit(W_NAME)
    floor = (lower - F.lit(W_AMOUNT) * 70 - F.lit(W_DATE) * 30) / F.lit(W_NAME)
    return F.when(ceiling >= floor, F.greatest(F.least(F.lit(80.0), ceiling), floor))


# Billing and queue

def billing_allowed(exempt: Column, status: Column, grace_until: Column, now: Column) -> Column:
    """Whether new documents may be taken. Unknown states are allowed; past due ones until their grace ends."""
    late = grace_until.isNotNull() & (now < grace_until)
    return (
        F.when(exempt, F.lit(True)).when(status.isNull(), F.lit(False)).when(status.isin("active", "trialing"), F.lit(True))
        .when(status.isin("past_due", "unpaid"), late).when(status.isin("canceled", "incomplete", "incomplete_expired", "paused"), F.lit(False)).otherwise(F.lit(True))
    )


def billing_in_grace(exempt: Column, status: Column, grace_until: Column, now: Column) -> Column:
    return ~exempt & F.coalesce(status.isin("past_due", "unpaid") & (now < grace_until), F.lit(False))


def billing_verdict(exempt: Column, status: Column, grace_until: Column, cancel_at_end: Column, period_end: Column, now: Column) -> Column:
    """A struct: allowed, in_grace, grace_until (within a grace period), reason and next_step (empty where there is nothing to say)."""
    allowed, grace = billing_allowed(exempt, status, grace_until, now), billing_in_grace(exempt, status, grace_until, now)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    late, running = status.isin("past_due", "unpaid"), status.isin("active", "trialing")
    ends = running & F.coalesce(cancel_at_end, F.lit(False))
    unfinished = status.isin("incomplete", "incomplete_expired")
    reason = (
        F.when(exempt, F.lit("exempt from billing")).when(status.isNull(), F.lit("no subscription")).when(ends, F.concat(F.lit("ends on "), day(period_end))).when(running, F.lit(""))
        .when(grace, F.concat(F.lit("payment is missing; everything works until "), day(grace_until))).when(late, F.lit("payment is missing and the grace period is over"))
        .when(status == "canceled", F.lit("the subscription has ended")).when(unfinished, F.lit("the application wasn't finished")).when(status == "paused", F.lit("the subscription is paused"))
        .otherwise(F.concat(F.lit("unknown state of subscription: "), status))
    )
    step = (
        F.when(exempt, F.lit("")).when(status.isNull(), F.lit("subscribe")).when(ends, F.lit("take back the cancellation to go on")).when(running, F.lit("")).when(late, F.lit("check the means of payment"))
        .when(status == "canceled", F.lit("subscribe again to go on")).when(unfinished, F.lit("start the application again")).when(status == "paused", F.lit("resume the subscription"))
        .otherwise(F.lit("nothing to do; the state is being looked into"))
    )
    return F.struct(allowed.alias("allowed"), grace.alias("in_grace"), F.when(grace, grace_until).alias("grace_until"), reason.alias("reason"), step.alias("next_step"))


GRACE_DAYS = 14


def grace_end(now: Column) -> Column:
    return now + F.expr(f"INTERVAL {GRACE_DAYS} DAYS")


def backoff_seconds(attempts: Column) -> Column:
    return attempts * attempts * 10


def label(code: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


LABELS = {
    "decision": {1: "auto", 2: "approved", 3: "corrected", 4: "rejected", 5: "review"},
    "document": {1: "waiting", 2: "processing", 3: "read", 4: "review", 5: "done", 9: "rejected"},
    "job": {1: "waiting", 2: "running", 3: "done", 4: "failed"},
    "settlement": {1: "auto", 2: "confirmed", 3: "review", 4: "none", 5: "cash"},
    "source": {1: "bank", 2: "card", 3: "other"},
    "doc_type": {1: "invoice", 2: "delivery note", 3: "receipt"},
}

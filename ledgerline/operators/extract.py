"""Fields from recognised text blocks: lines by position, then scored rules.

Building lines is greedy and depends on the order of blocks, so it runs in Python on sorted blocks; everything after is
DataFrame operations on the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ADDRESSES, CONTACTS, CORPORATE, LABELS, NARROW, REG_LABELS, TITLES, WIDE, ascii_fold, find_reg_no, find_reg_no_loose, looks_like_doc_no, looks_numeric, tidy_name
from ..functions.values import recognised_amount, with_recognised_date

#: How far centres may lie apart in one row, in heights.
ROW = 0.6
HONORIFICS = ["御中", "様"]
TOTALS, NUMBERS = ["合計金額", "合計", "総額", "御請求"], ["No.", "No", "番号", "伝票"]
#: Words that are looked for in the text of a line, each kind a bit of its number.
KINDS = {"corporate": CORPORATE, "title": TITLES, "to": HONORIFICS, "labelled": REG_LABELS, "label": LABELS, "contact": CONTACTS, "address": ADDRESSES, "totals": TOTALS, "numbers": NUMBERS, "money": ["¥", "\\", "円"]}
BIT = {k: 1 << i for i, k in enumerate(KINDS)}
FOLD = str.maketrans(WIDE + "ー−‐", NARROW + "---")
#: Texts whose kinds a worker remembers.
TEXTS = 1 << 16
LINE = {
    "document_id": pa.int64(), "line": pa.int32(), "text": pa.string(), "confidence": pa.float64(), "x": pa.int32(), "y": pa.int32(), "w": pa.int32(), "h": pa.int32(), "page_w": pa.int32(), "page_h": pa.int32(),
    "contacts": pa.int32(), "honor": pa.int32(), "by_total": pa.bool_(), "by_number": pa.bool_(), "kinds": pa.int32(),
}
LINES = ", ".join(f"{k} {({pa.int64(): 'long', pa.int32(): 'int', pa.string(): 'string', pa.float64(): 'double', pa.bool_(): 'boolean'})[v]}" for k, v in LINE.items())


def line_blocks(blocks: Iterable[dict]) -> list[dict]:
    """Blocks of one document, in reading order, to lines: a block joins the first row whose first block it is level with;
    within a row neighbours join from left to right until a gap is wider than the line is high."""
    rows: list[list[dict]] = []
    for b in blocks:
        if not (b["text"] or "").strip(" \t\r\n"):
            continue
        for r in rows:
            f = r[0]
            if abs((f["y"] + f["h"] / 2) - (b["y"] + b["h"] / 2)) < max(1, f["h"], b["h"]) * ROW:
                r.append(b)
                break
        else:
            rows.append([b])
    out: list[dict] = []
    for r in rows:
        r.sort(key=lambda b: b["x"])
        now = None
        for b in r:
            if now is None or b["x"] - (now["x"] + now["w"]) > now["h"]:
                now = {c: b[c] for c in ("text", "confidence", "x", "y", "w", "h")}
                out.append(now)
                continue
            now["text"] += b["text"]
            now["w"] = max(now["x"] + now["w"], b["x"] + b["w"]) - now["x"]
            now["h"] = max(now["h"], b["h"])
            now["confidence"] = min(now["confidence"], b["confidence"])
    return [{"line": i} | line for i, line in enumerate(out)]


def text_kinds(text: str) -> int:
    """The kinds of words in a text. Contacts may be in full-width signs; a title is none beside a corporate form."""
    found = sum(BIT[k] for k, p in _WORDS.items() if p.search(text.translate(FOLD) if k == "contact" else text))
    return found & ~BIT["title"] if found & BIT["corporate"] else found


_WORDS = {k: re.compile("|".join(map(re.escape, words))) for k, words in KINDS.items()}


def _same_row(a: dict, b: dict) -> bool:
    return abs((a["y"] + a["h"] / 2) - (b["y"] + b["h"] / 2)) < max(1, a["h"], b["h"]) * ROW


def _below(a: dict, b: dict) -> bool:
    """b lies under a: its top under a's middle, within eight heights of a's lower edge, and they overlap in x."""
    return b["y"] >= a["y"] + a["h"] / 2 and b["y"] - (a["y"] + a["h"]) <= a["h"] * 8 and b["x"] < a["x"] + a["w"] and a["x"] < b["x"] + b["w"]


def _honorific(a: dict, b: dict) -> int:
    """1 where the honorific b is in a's row, right after it; 2 where it stands under a; 0 otherwise."""
    if _same_row(a, b) and b["x"] > a["x"] and b["x"] - (a["x"] + a["w"]) < a["h"] * 6:
        return 1
    return 2 if _below(a, b) and b["y"] - (a["y"] + a["h"]) < a["h"] * 3 else 0


def look_around(lines: list[dict], known: dict[str, int]) -> None:
    """Adds to the lines of a document what their texts and the lines around them tell; known: kinds of texts seen before."""
    for a in lines:
        if (kinds := known.get(a["text"])) is None:
            if len(known) >= TEXTS:
                known.clear()
            kinds = known[a["text"]] = text_kinds(a["text"])
        a["kinds"] = kinds
    page_w, page_h = max(a["x"] + a["w"] for a in lines), max(a["y"] + a["h"] for a in lines)
    having = lambda *names: [a for a in lines if a["kinds"] & sum(BIT[n] for n in names)]
    near, honorifics, total, number = having("contact", "address"), having("to"), having("totals")[:1], having("numbers")[:1]
    for a in lines:
        a["page_w"], a["page_h"] = page_w, page_h
        a["contacts"] = sum(b is not a and _below(a, b) for b in near)
        a["honor"] = next((h for b in honorifics if b is not a and (h := _honorific(a, b))), 0)
        # In one row with the first line that holds any of the words, and right of it.
        a["by_total"], a["by_number"] = (any(_same_row(a, k) and a["x"] > k["x"] for k in first) for first in (total, number))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that come by document and in order, to lines."""
    names, known = ("text", "confidence", *"xywh"), {}
    out: list[dict] = []

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b[c].to_pylist() for c in ("document_id", *names)))

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a[c] for a in out], kind) for c, kind in LINE.items()], names=list(LINE))

    for doc, blocks in groupby(rows(), lambda r: r[0]):
        if found := line_blocks(dict(zip(names, r[1:])) for r in blocks):
            look_around(found, known)
            for a in found:
                a["document_id"] = doc
            out += found
        if len(out) >= 10_000:
            yield made()
            out = []
    if out:
        yield made()


def lines(blocks: DataFrame) -> DataFrame:
    ordered = blocks.repartition("document_id").sortWithinPartitions("document_id", "seq")
    return ordered.select("document_id", "text", "confidence", *"xywh").mapInArrow(_lines, LINES)


def _best(value: Column, score: Column, allowed: Column) -> Column:
    """The line with the best positive score of a document, the earlier one of equals."""
    row = F.struct(value.alias("value"), score.alias("score"), *(F.col(c) for c in ("confidence", "x", "y", "w", "h", "line")))
    good = allowed & (score > 0)
    return F.max_by(F.when(good, row), F.when(good, F.struct(F.round(score, 9), -F.col("line"))))


def extract_fields(blocks: DataFrame) -> DataFrame:
    """blocks (document_id, seq, text, confidence, x, y, w, h) to (document_id, field_key, value, confidence, bbox).

    What looks for words or around a line is known where lines are built; other patterns are only tried on lines that can
    hold them, and all choices are aggregates by document.
    """
    has = lambda *names: F.col("kinds").bitwiseAND(sum(BIT[n] for n in names)) != 0
    t, x, y = F.col("text"), F.col("x"), F.col("y")
    each = lines(blocks).withColumns({"digits": t.rlike("[0-9０-９]"), "upper": y < F.col("page_h") / 3, "folded": F.when(t.rlike("[！-～ー−‐]"), ascii_fold(t)).otherwise(t), **{k: has(k) for k in ("corporate", "title", "to", "labelled")}})
    # A date has a digit before a sign between its parts.
    each = with_recognised_date(each, "date", F.col("folded"), F.col("digits") & F.col("folded").rlike(r"[0-9]\s*[年月日/.\-]"))
    when = lambda c, s: F.when(c, F.lit(s)).otherwise(F.lit(0.0))
    named = (F.octet_length("text") >= 6) & ~has("label") & (F.col("date") == "") & ~looks_numeric(t)
    issuer = (
        when(F.col("contacts") >= 1, 0.35) + when(F.col("contacts") >= 2, 0.15) + when(F.col("upper") & (x >= F.col("page_w") / 2), 0.25) + when(y < F.col("page_h") / 8, 0.2)
        + when(F.col("corporate"), 0.25) - when(F.col("to") | (F.col("honor") != 0), 0.5) - when(F.col("title"), 0.5)
    )
    recipient = F.when(F.col("to") | (F.col("honor") == 1), 0.6).when((F.col("honor") == 2) & F.col("corporate"), 0.5).otherwise(0.0)
    recipient = recipient + when(F.col("upper") & (x < F.col("page_w") / 2), 0.2) + when(F.col("corporate"), 0.2) - when(F.col("title"), 0.5)
    marked = F.col("folded").contains("No")
    each = each.withColumns({
        "named": named, "reg": F.when(~F.col("digits"), F.lit("")).when(F.col("labelled"), find_reg_no_loose(t)).when(t.rlike("[TtＴｔ]"), find_reg_no(t)).otherwise(F.lit("")),
        "amount": F.when(F.col("digits") & (F.col("date") == ""), recognised_amount(t, F.col("folded"))),
        "number": F.when(marked, F.regexp_replace(F.regexp_replace("folded", "(?s)^.*?No", ""), "^[. :]+", "")).otherwise(F.col("folded")),
    })
    each = each.withColumns({"issuer": F.when(F.col("named") & ~has("contact"), issuer), "recipient": F.when(F.col("named"), recipient), "name": F.when(F.col("named"), tidy_name(t))})
    c = F.col
    chosen = _best(c("name"), c("issuer"), c("issuer").isNotNull())
    each = each.withColumn("issuer_line", F.max_by(F.when(c("issuer") > 0, c("line")), F.when(c("issuer") > 0, F.struct(F.round("issuer", 9), -c("line")))).over(Window.partitionBy("document_id")))
    not_issuer = c("recipient").isNotNull() & ~c("line").eqNullSafe(c("issuer_line"))
    picks = {
        "issuer_name": chosen, "recipient_name": _best(c("name"), c("recipient"), not_issuer),
        "reg_no": _best(c("reg"), F.when(c("labelled"), 0.95).otherwise(0.6), c("reg") != ""), "issue_date": _best(c("date"), 0.7 + when(c("upper"), 0.3), c("date") != ""),
        "total": _best(c("amount").cast("string"), 0.2 + when(c("by_total"), 0.6) + when(has("money"), 0.2), F.coalesce(c("amount") > 0, F.lit(False))),
        "doc_no": _best(c("number"), 0.2 + F.when(marked, 0.6).when(c("by_number"), 0.5).otherwise(0.0) + when(c("upper"), 0.1), looks_like_doc_no(c("number"))),
    }
    wide = each.groupBy("document_id").agg(*(v.alias(k) for k, v in picks.items())).withColumn("partner_name", c("recipient_name"))
    long = F.array(*(F.struct(F.lit(k).alias("field_key"), c(k).alias("b")) for k in [*picks, "partner_name"]))
    out = wide.select("document_id", F.explode(long).alias("f")).where("f.b.value IS NOT NULL AND f.b.value != ''")
    box = F.struct(*(c(f"f.b.{k}").alias(k) for k in ("x", "y", "w", "h")))
    return out.select("document_id", "f.field_key", c("f.b.value").alias("value"), (c("f.b.score") * c("f.b.confidence")).alias("confidence"), box.alias("bbox"))

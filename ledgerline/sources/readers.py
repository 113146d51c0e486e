"""Sources: statements as CSV, master lists and recognised blocks as JSON, documents as files."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import any_of
from ..functions.values import BANK, CARD, ledger_amount, ledger_amount_unsigned, ledger_date, stripped

# Header words of bank and card statements.
BANK_HEADERS = {"date": ["日付", "取引日", "年月日"], "description": ["摘要", "内容", "取引内容", "備考"], "out": ["出金", "支払", "引出", "お支払"], "in": ["入金", "預入", "お預入"]}
CARD_HEADERS = {"date": ["利用日", "日付"], "description": ["店名", "利用店", "ご利用先", "摘要", "内容"], "amount": ["金額"]}

LINES = "path string, file_sha256 string, line_no int, cells array<string>, error string"
BLOCK = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), *(T.StructField(c, T.IntegerType()) for c in "xywh")])
BLOCKS = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("blocks", T.ArrayType(BLOCK))])
MASTERS = T.StructType([T.StructField("id", T.LongType()), T.StructField("core", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("variants", T.ArrayType(T.StringType()))])


def decode_bytes(raw: bytes) -> str:
    """UTF-8, with or without a mark at the beginning; what isn't UTF-8 is Shift_JIS in its Windows form."""
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp932", "replace")


#: Cells that are quoted as a whole.
QUOTED = re.compile(r'(?:(?<=[,\r\n])|\A)"(?:[^"]|"")*"(?=[,\r\n]|\Z)')


#: Lines, and bytes of files, that make a batch.
BATCH_LINES, BATCH_BYTES = 10_000, 1 << 23
_LINE = pa.schema([("path", pa.string()), ("file_sha256", pa.string()), ("line_no", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


def _cells(raw: bytes) -> tuple[list[list[str]], str | None]:
    """The lines of a file, or none and what is wrong with it."""
    try:
        text = decode_bytes(raw)
        if '"' in text and '"' in QUOTED.sub("", text):
            raise csv.Error("a quote within a cell, or one that isn't closed")
        lines = list(csv.reader(io.StringIO(text, newline="")))
        return lines, None if lines else "empty file"
    except csv.Error as e:
        return [], f"not readable as CSV: {e}"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of many small files share a batch; a large one is cut into several."""
    csv.field_size_limit(1 << 31)
    rows, size = [], 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINE)], schema=_LINE)

    for b in batches:
        for path, raw in zip(b["path"], b["content"]):
            path, raw = path.as_py(), raw.as_py()
            digest = hashlib.sha256(raw).hexdigest()
            lines, error = _cells(raw)
            size += len(raw)
            for i, cells in enumerate(lines or [[]]):
                rows.append((path, digest, i, cells, error))
                if len(rows) >= BATCH_LINES:
                    yield full()
                    rows = []
            if size >= BATCH_BYTES and rows:
                yield full()
                rows, size = [], 0
    if rows:
        yield full()


def csv_lines(files: DataFrame) -> DataFrame:
    """Whole files (path, content) to numbered lines of cells; lines may have any number of them, quotes may hold breaks.
    A file that is empty or no CSV is one line without cells that tells the error."""
    return files.select("path", "content").mapInArrow(_parse, LINES)


def _columns(lines: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """Lines after the header with cell_<name> for each header word: the first header cell that contains any word, by file."""
    found = []
    for name, words in headers.items():
        has = lambda c, words=words: any_of(c, words)
        places = F.filter(F.transform("cells", lambda c, i: F.when(has(c), i)), lambda i: i.isNotNull())
        found.append(F.try_element_at(places, F.lit(1)).alias(f"at_{name}"))
    head = lines.where("line_no = 0").select("path", *found)
    cell = lambda name: F.coalesce(F.when(F.col(f"at_{name}").isNotNull(), F.try_element_at("cells", F.col(f"at_{name}") + 1)), F.lit("")).alias(f"cell_{name}")
    return lines.where("line_no > 0 AND size(cells) > 0").join(head, "path").select("path", "file_sha256", "line_no", "cells", *(cell(n) for n in headers))


def bank_rows(lines: DataFrame) -> DataFrame:
    """One row per line with money out (preferred) or in: direction 2 or 1, amount over 0. A bad date is marked in `error`,
    with its line; check_files() tells which files it spoils."""
    rows = _columns(lines, BANK_HEADERS)
    out, into = ledger_amount_unsigned(F.col("cell_out")), ledger_amount_unsigned(F.col("cell_in"))
    rows = rows.withColumns({"direction": F.when(out > 0, 2).when(into > 0, 1), "amount": F.when(out > 0, out).when(into > 0, into)})
    return _typed(rows.where("direction IS NOT NULL"), BANK)


def card_rows(lines: DataFrame) -> DataFrame:
    """Positive amounts are payments (2), negative ones refunds (1); lines of 0 are left out."""
    rows = _columns(lines, CARD_HEADERS).withColumn("signed", ledger_amount(F.col("cell_amount"))).where("signed != 0")
    return _typed(rows.withColumns({"direction": F.when(F.col("signed") > 0, 2).otherwise(1), "amount": F.abs("signed")}), CARD)


def _typed(rows: DataFrame, source: int) -> DataFrame:
    date = ledger_date(F.col("cell_date"))
    error = F.when(date.isNull(), F.format_string("line %d: no date in '%s'", F.col("line_no") + 1, F.col("cell_date")))
    return rows.select("path", "file_sha256", F.col("path").alias("file_id"), "line_no", F.lit(source).alias("source_type"), date.alias("transaction_date"), "amount", "direction", stripped(F.col("cell_description")).alias("description"), F.col("cells").alias("raw_data"), error.alias("error"))


def check_files(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, error) of files to reject as a whole: not readable, the first bad line, or no usable row at all."""
    bad = rows.where("error IS NOT NULL").groupBy("path").agg(F.min_by("error", "line_no").alias("error"))
    empty = lines.groupBy("path").agg(F.coalesce(F.max("error"), F.lit("no usable row")).alias("error")).join(rows.select("path").distinct(), "path", "left_anti")
    return bad.unionByName(empty)


def read_statements(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows of accepted files, rejected files) of CSV files under path; kind is bank or card."""
    lines = csv_lines(spark.read.format("binaryFile").load(path))
    rows = bank_rows(lines) if kind == "bank" else card_rows(lines)
    bad = check_files(lines, rows)
    return rows.join(bad.select("path"), "path", "left_anti"), bad


def read_masters(spark: SparkSession, path: str) -> DataFrame:
    """Partners of a JSON array; one without an id gets its place in the file, from 1."""
    return parse_masters(spark.read.option("wholetext", True).text(path))


def parse_masters(files: DataFrame) -> DataFrame:
    each = files.select(F.posexplode(F.from_json("value", T.ArrayType(MASTERS))).alias("place", "m"))
    return each.select(F.coalesce("m.id", F.col("place") + 1).cast("long").alias("id"), "m.core", "m.canonical", "m.variants")


def master_aliases(masters: DataFrame) -> DataFrame:
    return masters.select(F.col("id").alias("partner_id"), "canonical", F.explode("variants").alias("alias")).where("alias != canonical").select("partner_id", "alias", F.lit(1).alias("source"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Recognised blocks, one row each, numbered in their order."""
    return explode_blocks(spark.read.schema(BLOCKS).json(path))


def explode_blocks(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.posexplode("blocks").alias("seq", "b")).select("document_id", "seq", "b.*")


_POINT = "struct<x:int,y:int>"
_WORD = f"struct<confidence:double,boundingBox:struct<vertices:array<{_POINT}>>,symbols:array<struct<text:string>>>"
_PAGE = f"struct<blocks:array<struct<paragraphs:array<struct<words:array<{_WORD}>>>>>>"
VISION = f"struct<responses:array<struct<fullTextAnnotation:struct<pages:array<{_PAGE}>>>>>"


def vision_blocks(responses: DataFrame) -> DataFrame:
    """(document_id, body: JSON of a recognition service) to one block per word, in the order given; a box is the extent of
    its vertices, where a missing coordinate is 0."""
    doc = responses.select("document_id", F.from_json("body", VISION).alias("r"))
    words = F.flatten(F.flatten(F.flatten(F.flatten(F.transform("r.responses", lambda r: F.transform(r.fullTextAnnotation.pages, lambda p: F.transform(p.blocks, lambda b: F.transform(b.paragraphs, lambda g: g.words))))))))
    each = doc.select("document_id", F.posexplode(words).alias("seq", "w"))
    text = F.array_join(F.transform("w.symbols", lambda s: s.text), "")
    xs = F.transform("w.boundingBox.vertices", lambda v: F.coalesce(v.x, F.lit(0)))
    ys = F.transform("w.boundingBox.vertices", lambda v: F.coalesce(v.y, F.lit(0)))
    return each.select("document_id", "seq", text.alias("text"), F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def document_kind(path: Column, content: Column) -> Column:
    """A PDF needs both its extension and its first bytes; images go by extension."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    pdf = name.endswith(".pdf") & (F.substring(content, 1, 4) == F.lit(b"%PDF"))
    return F.when(pdf, "pdf").when(name.endswith(".pdf"), "invalid").when(name.rlike(r"\.(png|jpe?g)$"), "image").otherwise("other")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", document_kind(F.col("path"), F.col("content")).alias("kind"), "length", F.sha2("content", 256).alias("file_sha256"), "content")


REGISTRY_BATCH = 10


def lookup_batches(numbers: DataFrame) -> DataFrame:
    """Registration numbers in batches of ten for a lookup service."""
    from pyspark.sql import Window

    order = Window.partitionBy("client_id").orderBy("reg_no")
    return numbers.select("client_id", "reg_no").distinct().withColumn("batch", F.floor((F.row_number().over(order) - 1) / REGISTRY_BATCH))


def lookup_answers(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """What a lookup of batches (client_id, reg_no, batch) gave: answers (client_id, batch, status: of the service, body:
    its JSON). A batch that failed or has no answer leaves its numbers unanswered and spoils no other; a number that a
    good answer doesn't name is not registered. client_id, reg_no, answered, found, name, address, revoked_on."""
    entry = "struct<registratedNumber:string,name:string,address:string,disposalDate:string>"
    told = answers.select("client_id", "batch", "status", F.from_json("body", f"struct<announcement:array<{entry}>>").alias("b"))
    good = (F.col("status") == 200) & F.col("b").isNotNull() & F.col("b.announcement").isNotNull()
    ok = told.where(good).select("client_id", "batch", "b.announcement")
    # At most ten entries for each batch.
    both = batches.join(ok, ["client_id", "batch"], "left")
    hit = F.get(F.filter("announcement", lambda e: F.concat(F.lit("T"), e.registratedNumber) == F.col("reg_no")), F.lit(0))
    out = both.select("client_id", "reg_no", F.col("announcement").isNotNull().alias("answered"), hit.alias("e"))
    return out.select("client_id", "reg_no", "answered", F.when(F.col("answered"), F.col("e").isNotNull()).alias("found"), F.col("e.name").alias("name"), F.col("e.address").alias("address"), F.nullif("e.disposalDate", F.lit("")).alias("revoked_on"))


def signature(secret: str, parts: list[Column], body: Column) -> Column:
    """HMAC-SHA256 in hex of the parts and the body's SHA-256 in hex, one to a line."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ x for k in key)) for x in (0x36, 0x5C))
    message = F.concat_ws("\n", *(p.cast("string") for p in parts), F.sha2(body.cast("binary"), 256))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def signed(requests: DataFrame, secret: str, version: str = "v1") -> DataFrame:
    """requests (method, path, query, sent_at in seconds, organization_id, body, signature as version=hex) whose signature is right."""
    parts = [F.lit(version), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("method", "path", "query", "sent_at", "organization_id"))]
    return requests.where(F.lower("signature") == F.concat(F.lit(f"{version}="), signature(secret, parts, F.coalesce(F.col("body").cast("binary"), F.lit(b"")))))


EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("subscription_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("payment_failed", T.BooleanType()), T.StructField("payment_succeeded", T.BooleanType()), T.StructField("received_at", T.TimestampType()),
])


def webhook_events(bodies: DataFrame) -> DataFrame:
    """(body, received_at) JSON of subscription and invoice events to EVENT rows; other types are left out."""
    schema = "struct<id:string,type:string,data:struct<object:struct<id:string,subscription:string,status:string>>>"
    e = bodies.select(F.from_json("body", schema).alias("e"), "received_at")
    invoice = F.col("e.type").startswith("invoice.")
    sub = F.when(invoice, F.col("e.data.object.subscription")).otherwise(F.col("e.data.object.id"))
    status = F.when(F.col("e.type") == "customer.subscription.deleted", "canceled").when(~invoice, F.col("e.data.object.status"))
    known = F.col("e.type").isin("customer.subscription.created", "customer.subscription.updated", "customer.subscription.deleted", "invoice.payment_failed", "invoice.payment_succeeded")
    return e.where(known).select(F.col("e.id").alias("event_id"), F.col("e.type").alias("type"), sub.alias("subscription_id"), status.alias("status"), (F.col("e.type") == "invoice.payment_failed").alias("payment_failed"), (F.col("e.type") == "invoice.payment_succeeded").alias("payment_succeeded"), "received_at")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational database; with a numeric key and its bounds it is read in parts at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_sheets(df: DataFrame, path: str) -> None:
    """One CSV with a header for each partition."""
    df.write.mode("overwrite").option("header", True).csv(path)

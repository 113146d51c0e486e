"""URL filter by rules and by the ratio of two character language models.

Both models are variable-order Markov models: the probability of a character is interpolated over contexts of none to
ORDER characters, each order weighted by how often its context was seen (Witten-Bell). One is of URLs that the rules
allow, one of those they block. Their counts are exact tables with a row for each context and character that occurs, so
they grow with the data and stay distributed: nothing of them is collected or sent to all executors. Probabilities are
found order by order, each from a join with those of the next shorter context, in which a row has at most as many
partners as there are characters.

A URL without a rule is blocked where its log-likelihood difference for each character is above a threshold. One in FOLDS
of the URLs with a rule is left out of the counts and calibrates it: there allowed and blocked ones are told apart best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship

#: Host, path and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Characters are UTF-8 bytes and START, which stands before the first.
ORDER, START, BASE = 4, 256, 257
BINS, REACH = 400, 4.0
FOLDS = 4
#: Rows of a block, within which equal grams are looked up once.
BLOCK = 4096


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as its text; null if none does."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def verdict(rule_: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for h, p, v in rules:
        out = F.when(rule_ == h + p, F.lit(v)).otherwise(out)
    return out


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(URL of each character, the ORDER characters before it and itself as one number to BASE), over UTF-8 bytes."""
    raw = [u.encode("utf-8", "replace") + b"\n" for u in urls]
    lengths = np.array([len(r) for r in raw], np.int64)
    code = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    which = np.repeat(np.arange(len(raw)), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    gram = code.copy()
    for k in range(1, ORDER + 1):
        past = np.full(len(code), START, np.int64)
        past[k:] = np.where(place[k:] < k, START, code[:-k])
        gram += past * BASE**k
    return which, gram


def _counts(batches):
    """(url, blocked) rows to (gram, allowed, blocked), each gram once for a batch."""
    for b in batches:
        which, gram = _grams(b.column(0).to_pylist())
        kind = b.column(1).to_numpy(zero_copy_only=False).astype(bool)[which]
        gram, at = np.unique(gram, return_inverse=True)
        each = [np.bincount(at[kind == k], minlength=len(gram)) for k in (False, True)]
        yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, each)], names=["gram", "n0", "n1"])


def _asked(batches):
    """(block, url) rows to the distinct grams of each block."""
    for b in batches:
        which, gram = _grams(b.column(1).to_pylist())
        block = b.column(0).to_numpy()[which]
        order = np.lexsort([gram, block])
        block, gram = block[order], gram[order]
        new = np.r_[True, (block[1:] != block[:-1]) | (gram[1:] != gram[:-1])] if len(gram) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(gram[new])], names=["block", "gram"])


def probabilities(grams: DataFrame) -> DataFrame:
    """Grams, each once, with their counts n0 and n1 in the two classes (or 0), to (gram, p0, p1).

    Of order k, a row is a context of k characters with the one after it; what precedes them in the gram makes the rows
    of order k + 1. A context that was never seen has the probabilities of the next shorter one.
    """
    shorter = None
    for k in range(ORDER + 1):
        rows = grams.groupBy(F.expr(f"gram % {BASE ** (k + 1)}L").alias("after")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        rows = rows.withColumns({"before": F.expr(f"after div {BASE}"), "lower": F.expr(f"after % {BASE**k}L")})
        seen = rows.groupBy("before").agg(*(x for c in (0, 1) for x in (F.sum(f"n{c}").alias(f"seen{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"kinds{c}"))))
        rows = rows.join(seen, "before")
        if shorter is None:
            rows = rows.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            rows = rows.join(shorter.select(F.col("after").alias("lower"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "lower")
        mixed = lambda c: (F.col(f"n{c}") + F.col(f"kinds{c}") * F.col(f"q{c}")) / (F.col(f"seen{c}") + F.col(f"kinds{c}"))
        shorter = rows.select("after", *(F.when(F.col(f"seen{c}") > 0, mixed(c)).otherwise(F.col(f"q{c}")).alias(f"p{c}") for c in (0, 1)))
    return shorter.withColumnRenamed("after", "gram")


def _score(rows: pa.Table, known: pa.Table) -> pa.Table:
    """A block's rows with their scores; known: the log-likelihood differences of the block's grams."""
    which, gram = _grams(rows.column("url").to_pylist())
    own, first = np.unique(known.column("gram").to_numpy(), return_index=True)
    diff = known.column("diff").to_numpy()[first][np.searchsorted(own, gram)]
    score = np.bincount(which, diff, rows.num_rows) / np.bincount(which, minlength=rows.num_rows)
    return rows.drop_columns(["block", "url"]).append_column("score", pa.array(score, pa.float64()))


def scored(spark: SparkSession, rows: DataFrame, counted: DataFrame) -> DataFrame:
    """rows (block, url and others) with the log-likelihood of each URL as a blocked one less that as an allowed one, for each
    character, in place of block and url. counted: (url, blocked) rows for the models. URLs are not null."""
    asked = materialise(spark, rows.select("block", "url").mapInArrow(_asked, "block long, gram long"), "asked")
    grams = counted.select("url", "blocked").mapInArrow(_counts, "gram long, n0 long, n1 long").union(asked.select("gram", F.lit(0), F.lit(0)))
    grams = materialise(spark, grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    diffs = materialise(spark, probabilities(grams).select("gram", (F.log("p1") - F.log("p0")).alias("diff")), "diffs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("block", "url"))
    return rows.groupBy("block").cogroup(asked.join(diffs, "gram").groupBy("block")).applyInArrow(_score, f"{schema}, score double")


def threshold(histogram: dict[tuple[int, int], int]) -> float:
    """Where the two classes' error rates add up to least, from counts by (blocked, bin); the middle of what is best."""
    n = np.zeros((2, BINS + 1))
    for (kind, b), x in histogram.items():
        n[kind, b] += x
    share = np.cumsum(n, axis=1) / np.maximum(1, n.sum(1, keepdims=True))  # at or below the bin
    loss = (1 - share[0]) + share[1]
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return (float(best[len(best) // 2]) + 1) / BINS * 2 * REACH - REACH


def bin_of(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor((score + REACH) / (2 * REACH) * BINS))).cast("int")


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A null URL or one without `://` has an empty host and path, and no rule. score is the length-normalised ratio. Where
    the URLs that calibrate hold only one of the classes, the method allows. Rows that repeat are judged alike; a null
    page_id stays null; an empty table gives no rows; further columns are ignored whatever their names.
    """
    ship(spark)
    held = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    held = held.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "url": F.coalesce("url", F.lit(""))})
    held = held.withColumns({"rule": rule(F.col("host"), F.col("path"), rules), "block": F.floor(F.monotonically_increasing_id() / BLOCK)})
    held = held.withColumns({"blocked": verdict(F.col("rule"), rules) == "block", "calibrates": F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0})
    held = materialise(spark, held, "urls")
    found = scored(spark, held, held.where("rule is not null and not calibrates"))
    found = materialise(spark, found, "scored")
    bins = found.where("rule is not null and calibrates").groupBy(F.col("blocked").cast("int").alias("kind"), bin_of(F.col("score")).alias("bin")).count()
    counts = {(r.kind, r.bin): r["count"] for r in bins.collect()}  # at most two for each bin
    bar = threshold(counts) if {k for k, _ in counts} == {0, 1} else float("inf")
    own = F.when(F.col("score") >= bar, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", F.coalesce(verdict(F.col("rule"), rules), own).alias("verdict"), "score")

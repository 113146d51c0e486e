"""Secrets in texts: fixed patterns, and a randomness test battery with false-discovery control. DataFrame functions only.

Tokens of 20 or more characters with letters and digits are tested for being random, in the encoding that is inferred
(hexadecimal, base 32, base 36, base 64): Pearson's chi-squared of the symbol counts against a uniform alphabet, the
Wald-Wolfowitz runs test of symbols above and below the alphabet's middle, and the serial correlation of neighbouring
symbols. A token is a candidate while none of the three rejects randomness (Bonferroni, level ``BATTERY``). Its p-value
as ordinary text is the chance that an ordinary identifier of its length changes character class as often; longer tokens
say more and weigh more, so p is divided by the token's
length over the mean length of all candidates, and the Benjamini-Hochberg step over all candidates' weighted values
(held as counts in bins of log p, not as rows) gives the bar that accepted tokens must pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Fixed patterns, the group whose length counts, and the least length.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": (ASSIGN, 1, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
#: Tokens of which an encoding may be inferred. What fixed patterns found is BLANK in the text that is searched, and a
#: token of which it holds a part is no match.
BLANK = "\ue000"
TOKEN = rf"(?<![A-Za-z0-9+/_{BLANK}-])(?=[A-Za-z0-9+/_-]{{20}})(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]++(?!{BLANK})={{0,2}}"
#: In the order in which they are tried.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
    "base32": ("abcdefghijklmnopqrstuvwxyz234567", r"^(?:[A-Z2-7]+|[a-z2-7]+)$"),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", r"^(?:[0-9a-z]+|[0-9A-Z]+)$"),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/_-]+$"),
}
#: Level of the battery, false-discovery rate, chance of a class change between neighbours in ordinary identifiers, bins of -log10 p.
BATTERY, RATE, CHANGE, BINS = 0.001, 0.01, 0.15, 10
#: -log p beyond which candidates count alike; the bar never lies above.
STRONGEST = 100.0
KINDS = ["assign", "access", "hex", "random"]
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
MATCH = "array<struct<start:bigint,end:bigint,size:bigint,whole:string>>"
#: Matches whose places are found in one go.
BLOCK = 128


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _length(x: Column) -> Column:
    return F.char_length(x).cast("long")


def placed(rows: Column) -> Column:
    """Rows (gap before, length, size, whole) to matches with their places: those of a block of rows one after another, and
    those of blocks from the blocks' lengths, so arrays that grow stay short."""

    def step(acc, r):
        start = acc.at + r.gap
        found = F.struct(start.alias("start"), (start + r.length).alias("end"), r["size"].alias("size"), r.whole.alias("whole"))
        return F.struct((start + r.length).alias("at"), F.concat(acc.out, F.array(found)).alias("out"))

    empty = F.array().cast(MATCH).alias("out")
    within = lambda x, at: F.aggregate(x, F.struct(at.alias("at"), empty), step, lambda a: a.out)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, r: n + r.gap + r.length)
    add = lambda acc, n: F.struct((acc.at + n).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))
    starts = lambda sums: F.aggregate(sums, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), add, lambda a: a.out)
    cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), lambda k: F.slice(r, k * BLOCK + 1, F.lit(BLOCK)))
    return let(rows, lambda r: let(cut(r), lambda blocks: F.flatten(F.zip_with(blocks, starts(F.transform(blocks, total)), within))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches with their places in code points, the size of the group, and what is matched."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    row = lambda r, p: F.struct(_length(r.gap).alias("gap"), _length(r.whole).alias("length"), _length(p).alias("size"), r.whole.alias("whole"))
    # What lies between matches gives their places; the last piece has no match after it.
    rows = let(whole, lambda w: F.zip_with(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(w)), w, lambda g, x: F.struct(g.alias("gap"), x.alias("whole"))), part, row))
    return F.when(text.rlike(pattern), placed(rows)).otherwise(F.array().cast(MATCH))


def spans(found: Column, least: int, kind: int) -> Column:
    return F.transform(F.filter(found, lambda m: m["size"] >= least), lambda m: F.struct(m.start.alias("start"), F.lit(kind).alias("kind"), m.end.alias("end")))


def blanked(text: Column, pattern: str, group: int, least: int) -> Column:
    """text with BLANK for each character of the spans."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    filler = F.zip_with(whole, part, lambda w, p: F.when(F.char_length(p) >= least, F.repeat(F.lit(BLANK), F.char_length(w))).otherwise(w))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), filler, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def loose(text: Column) -> Column:
    """start:end:token of the tokens that no span of a fixed pattern overlaps."""
    as_text = lambda x: F.transform(matches(x, TOKEN), lambda m: F.concat_ws(":", m.start.cast("string"), m.end.cast("string"), m.whole))
    found = as_text(text)
    for name, (pattern, group, least) in PATTERNS.items():
        without = F.array_intersect(found, as_text(blanked(text, pattern, group, least)))
        found = F.when(F.size(f"_{name}") > 0, without).otherwise(found)
    return found


def digest(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution by the Zelen-Severo series; within 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    s = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * s
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, c: a + c)


def _with(row: Column, keep: list[str], **new: Column) -> Column:
    return F.struct(*(row[k].alias(k) for k in keep), *(v.alias(k) for k, v in new.items()))


def tested(tokens: Column) -> Column:
    """Array of (start, end, token) to array of (start, end, n, strength, random), tokens without an encoding left out.

    random: none of the three tests rejects; strength: -log of the p-value as ordinary text. Each step's fields are the
    next step's inputs, so no expression is computed twice.
    """
    place = ["start", "end"]
    body = lambda t: F.regexp_replace(t.token, "=+$", "")

    def encoding(b: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, (_, pattern) in reversed(ENCODINGS.items()):
            found = F.when(b.rlike(pattern), F.lit(name)).otherwise(found)
        return found

    def symbols(t: Column) -> Column:
        chars = F.filter(F.split(F.when(t.encoding == "base64", F.translate(t.body, "-_", "+/")).otherwise(F.lower(t.body)), ""), lambda c: c != "")
        alphabet = F.lit(None).cast("string")
        for name, (letters, _) in ENCODINGS.items():
            alphabet = F.when(t.encoding == name, F.lit(letters)).otherwise(alphabet)
        return F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - 1)

    def size(t: Column) -> Column:
        out = F.lit(None).cast("double")
        for name, (letters, _) in ENCODINGS.items():
            out = F.when(t.encoding == name, F.lit(float(len(letters)))).otherwise(out)
        return out

    def shape(b: Column) -> Column:
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(b, "[^A-Za-z]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
        return F.length(classes).cast("double") - 1

    a = F.filter(F.transform(tokens, lambda t: _with(t, place, body=body(t), encoding=encoding(body(t)))), lambda t: t.encoding.isNotNull())
    b = F.transform(a, lambda t: _with(t, place, x=symbols(t), k=size(t), changes=shape(t.body)))
    c = F.transform(b, lambda t: _with(
        t, [*place, "k", "changes", "x"], n=F.size(t.x).cast("double"), mean=_sum(t.x) / F.size(t.x),
        ups=_sum(F.transform(t.x, lambda v: (v > (t.k - 1) / 2).cast("double"))),
        squares=_sum(F.transform(F.array_distinct(t.x), lambda v: F.pow(F.size(F.filter(t.x, lambda w: w == v)).cast("double"), F.lit(2.0)))),
        pairs=F.arrays_zip(F.slice(t.x, F.lit(1), F.size(t.x) - 1).alias("p"), F.slice(t.x, F.lit(2), F.size(t.x) - 1).alias("q")),
    ))
    d = F.transform(c, lambda t: _with(
        t, [*place, "k", "n", "ups", "changes"], chi=t.k / t.n * t.squares - t.n,
        runs=1 + _sum(F.transform(t.pairs, lambda r: ((r["p"] > (t.k - 1) / 2) != (r["q"] > (t.k - 1) / 2)).cast("double"))),
        serial=_sum(F.transform(t.pairs, lambda r: (r["p"] - t.mean) * (r["q"] - t.mean))) / F.greatest(F.lit(1e-9), _sum(F.transform(t.x, lambda v: (v - t.mean) * (v - t.mean)))),
        mean_runs=1 + 2 * t.ups * (t.n - t.ups) / t.n,
    ))
    e = F.transform(d, lambda t: _with(
        t, [*place, "n"],
        z_chi=(F.pow(F.greatest(F.lit(0.0), t.chi) / (t.k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (t.k - 1)))) / F.sqrt(2 / (9 * (t.k - 1))),
        z_runs=F.abs(t.runs - t.mean_runs) / F.sqrt(F.greatest(F.lit(1e-9), (t.mean_runs - 1) * (t.mean_runs - 2) / (t.n - 1))),
        z_serial=F.abs(t.serial + 1 / t.n) * F.sqrt(t.n),
        z_text=(t.changes - CHANGE * (t.n - 1)) / F.sqrt((t.n - 1) * CHANGE * (1 - CHANGE)),
    ))
    return F.transform(e, lambda t: _with(
        t, place, n=t.n.cast("long"),
        strength=F.when(t.z_text < 5, -F.log(normal_tail(t.z_text))).otherwise(t.z_text * t.z_text / 2 + F.log(t.z_text) + 0.9189385332),
        random=3 * F.least(normal_tail(t.z_chi), 2 * normal_tail(t.z_runs), 2 * normal_tail(t.z_serial)) >= BATTERY,
    ))


def bar(counts: dict[int, int], tests: int) -> float:
    """The least strength at which Benjamini-Hochberg accepts; counts: candidates by bin floor(BINS * strength)."""
    above, found = 0, math.inf
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if math.exp(-b / BINS) <= RATE * above / max(1, tests):
            found = b / BINS
    return found


def find_secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    A span is kind:start:end in code points, end exclusive. The fixed patterns' spans always stay; kind `random` holds
    what the battery adds beside them, where it overlaps none. A null or empty text has no spans: the digest is that of
    the empty string and spans is empty. Rows that repeat or have a null doc_id each get their own result; an empty
    table gives no rows; further columns are ignored whatever their names. No row is shuffled: only bin counts are.
    """
    text = F.col("_text")
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    for kind, (name, (pattern, group, least)) in enumerate(PATTERNS.items()):
        held = held.withColumn(f"_{name}", spans(matches(text, pattern, group), least, kind))
    held = held.withColumn("_base", F.concat(*(f"_{k}" for k in PATTERNS)))
    part = lambda x, i: F.split_part(x, F.lit(":"), F.lit(i))
    held = held.withColumn("_loose", F.transform(loose(text), lambda x: F.struct(part(x, 1).cast("long").alias("start"), part(x, 2).cast("long").alias("end"), part(x, 3).alias("token"))))
    sizes = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]
    held = materialise(spark, held.select("doc_id", *sizes, "_base", tested(F.col("_loose")).alias("_tested")), "secrets")

    each = held.where(F.size("_tested") > 0).select(F.explode("_tested").alias("t")).select("t.*")
    tests, total = each.agg(F.count("*"), F.sum("n")).first()
    mean = float(total or 0) / max(1, tests) or 1.0
    weighted = lambda t: t["strength"] + F.log(t["n"] / F.lit(mean))
    bins = each.where("random").select(F.least(F.lit(int(STRONGEST) * BINS), F.floor(BINS * weighted(each))).cast("int").alias("bin"))
    need = bar({r["bin"]: r["count"] for r in bins.groupBy("bin").count().collect()}, tests)
    found = F.filter("_tested", lambda t: t.random & (F.least(F.lit(STRONGEST), weighted(t)) >= F.lit(need)))
    more = F.transform(found, lambda t: F.struct(t.start.alias("start"), F.lit(len(PATTERNS)).alias("kind"), t.end.alias("end")))
    return held.select(
        "doc_id", *(f"n_{k}" for k in PATTERNS), F.sha2(digest(F.col("_base")), 256).alias("base_sha256"),
        digest(F.concat("_base", more)).alias("spans"), F.size(more).cast("long").alias("n_random"),
    )

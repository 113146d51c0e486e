"""Toxicity of whole texts behind a noisy channel: restore obfuscated spellings, then score the restored words.

The channel writes letters as look-alike digits and signs, repeats them, or sets them apart. A token that shows signs
of it becomes a lattice of characters (each look-alike as the letters it may stand for, or left out; each run of three
or more as one or two), and the Viterbi path under a character trigram model is its restored form. The model's counts
cover every text of the corpus. Tokens of letters alone have one path, their own.

A text is a lattice too, in which every gap between pieces may be a space or nothing. A piece of two or more plain
letters fixes the model's state, so the best path is found stretch by stretch between such pieces: where nothing stands
between two of them, by comparing both readings of the gap for all gaps of a block of texts at once, else by the Viterbi
path, once for equal stretches. Words that come about so are added to those of the text as it is written.

Scores come from a logistic model over the words and word beginnings that a restored text holds, fitted on a bounded
sample of the labelled rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, text_or_empty
from .tokenizing import Slots, distinct_words, ragged

#: What look-alikes may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Costs in nats of a look-alike, of a sign left out, of a run kept double, of a gap that is none.
COST_LOOK, COST_DROP, COST_DOUBLE, COST_GAP = 1.0, 2.5, 0.7, 1.0
SYMBOLS, OTHER = 64, 60
#: Rows of each label in the training sample.
PER_CLASS = 4000
#: Standard deviations by which a feature's toxic share must exceed the sample's.
TELLING = 3.5
PREFIXES = (4, 5, 6)
TRIM = ".,;:?!%&*#\"'`()[]{}<>=_~^/\\-…«»“”„’‘¡¿"
RUN3 = re.compile(r"(.)\1\1")
APART = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+€])){2,}(?!\S)")
#: Texts without a match have none of APART.
MAYBE_APART = r"(?:^|\s)[^\s][ .\-_*]{1,2}[^\s][ .\-_*]{1,2}[^\s](?:$|[\s.\-_*])"


def symbol_table() -> np.ndarray:
    """Code point to symbol: 0 a boundary, 1-26 a-z, 27-59 letters from U+00DF, 60 what else there is, 61 digits."""
    t = np.full(256, OTHER, np.int64)
    for c in range(256):
        if chr(c).isspace():
            t[c] = 0
        elif 97 <= c <= 122:
            t[c] = c - 96
        elif 48 <= c <= 57:
            t[c] = 61
        elif c >= 0xDF and chr(c).isalpha():
            t[c] = 27 + c - 0xDF
    return t


TABLE = symbol_table()


SYMBOL = {chr(c): s for c, s in enumerate(TABLE.tolist())}


def symbol(c: str) -> int:
    return SYMBOL.get(c, OTHER)


def _trigrams(batches, block: int = 1 << 20):
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in batches:
        code = np.frombuffer(f" {' '.join(pc.utf8_lower(b.column(0)).to_pylist())} ".encode("utf-32-le", "replace"), "<u4")
        for i in range(0, len(code), block):
            part = code[i : i + block + 2]
            s = np.where(part < 256, TABLE[np.minimum(part, 255)], OTHER)
            if len(s) > 2:
                total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    slots = np.flatnonzero(total)
    if len(slots):
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], names=["slot", "n"])


class CharacterModel:
    """Log-probabilities of a character after two others, interpolated with those after one and none."""

    def __init__(self, counts: dict[int, int] | np.ndarray):
        n3 = np.zeros(SYMBOLS**3)
        if isinstance(counts, dict):
            n3[list(counts)] = list(counts.values())
        n3 = n3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
        p2 = (n2 + 20 * p1) / (n2.sum(1, keepdims=True) + 20)
        p3 = (n3 + 20 * p2[None]) / (n3.sum(2, keepdims=True) + 20)
        self.log = np.log(p3)


def trimmed(token: str) -> str:
    """token without runs of three or more of a sign at its ends, and without signs that enclose it."""
    start, end = 0, len(token)

    def run(at: int, step: int) -> int:
        c, n = token[at], 0
        while start <= at < end and token[at] == c:
            at, n = at + step, n + 1
        return 0 if n < 3 or c.isalnum() or c == "_" or c.isspace() else n

    while start < end and (n := run(start, 1)):
        start += n
    while start < end and (n := run(end - 1, -1)):
        end -= n
    return token[start:end].strip(TRIM)


class Restorer:
    """Restored forms of tokens and of what stands between plain words; those seen are kept, up to MOST characters of them."""

    MOST = 1_500_000

    def __init__(self, model: CharacterModel):
        self.log, self.rows = model.log, model.log.tolist()
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, str] = {}
        self.gaps: dict[tuple, tuple[str, bool]] = {}
        self.held = 0

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Per position, what the character may have been, with the channel's cost."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            run, here = j - i, []
            letters = [(c, 0.0)] if c.isalpha() else [(x, COST_LOOK) for x in LOOKS.get(c, "")]
            for letter, cost in letters:
                if run >= 3:
                    here += [(letter, cost), (letter * 2, cost + COST_DOUBLE)]
                else:
                    here.append((letter * run, cost * run))
            if not c.isalpha():
                here += [(c * min(run, 2), 0.0), ("", COST_DROP)]
            out.append(here)
            i = j
        return out

    def path(self, steps: list[list[tuple[str, float]]], start: tuple[int, ...] = (0, 0), end: tuple[int, ...] = (0,)) -> str:
        """The Viterbi path through choices at each step, from the symbols of start to those of end (boundaries, if not
        given). A state is the last two symbols; paths are linked backwards."""
        rows, known = self.rows, SYMBOL.get
        states = {tuple(start): (0.0, None)}
        for choices in steps:
            new: dict[tuple[int, int], tuple] = {}
            for (a, b), (score, back) in states.items():
                for chars, cost in choices:
                    x, y, total = a, b, score - cost
                    for c in chars:
                        z = known(c, OTHER)
                        total += rows[x][y][z]
                        x, y = y, z
                    old = new.get((x, y))
                    if old is None or total > old[0]:
                        new[x, y] = (total, (back, chars))
            states = new
        best, back = -math.inf, None
        for (x, y), (total, link) in states.items():
            for z in end:
                total += rows[x][y][z]
                x, y = y, z
            if total > best:
                best, back = total, link
        out = []
        while back is not None:
            back, chars = back
            out.append(chars)
        return "".join(reversed(out))

    def stretch(self, before: tuple[int, ...], inner: tuple[str, ...], after: tuple[int, ...]) -> tuple[str, bool]:
        """What the pieces between two plain words (the symbols at their ends; none at a boundary) are with their gaps,
        and whether that differs from how they are written."""
        key = before, inner, after
        found = self.gaps.get(key)
        if found is None:
            gap, even = [(" ", 0.0), ("", COST_GAP)], [(" ", 0.0), ("", 0.0)]
            steps = []
            for i, token in enumerate(inner):
                # Where single letters follow each other, a gap tells nothing about words.
                here = even if i and len(token) == len(inner[i - 1]) == 1 else gap
                steps += ([here] if before or i else []) + self.lattice(token)
            steps += [gap] * bool(after)
            read = self.path(steps, before or (0, 0), after or (0,))
            written = f"{' ' * bool(before)}{' '.join(inner)}{' ' * bool(after)}"
            found = read, read != written
            self.keep(sum(map(len, inner)) + 8)
            self.gaps[key] = found
        return found

    def keep(self, size: int) -> None:
        if self.held > self.MOST:
            self.forget()
        self.held += size

    def word(self, token: str) -> str:
        """A lower-case token without what encloses it, restored where it shows signs of the channel."""
        if token.isalpha() and not RUN3.search(token):
            return token
        found = self.seen.get(token)
        if found is None:
            core = trimmed(token)
            plain = core.isalpha() and not RUN3.search(core)
            found = core if plain or not any(map(str.isalpha, core)) or core.isdigit() else self.path(self.lattice(core))
            self.keep(len(token))
            self.seen[token] = found
        return found


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


def unpacked(bits):
    return *((bits >> i & 1) == 1 for i in range(4)), np.int16(bits >> 4 & 4095), np.int16(bits >> 16 & 4095)


class Finder:
    """The features of whole texts, a block of texts at a time. number: of a feature, or None if it isn't asked for; names:
    of all features that are, if there is a list of them."""

    #: Characters of tokens of which the description is kept at most.
    MOST = 2_500_000

    def __init__(self, model: CharacterModel, number: Callable[[str], int | None], names: list[str] | None = None):
        self.restorer, self.number, self.known, self.held = Restorer(model), number, {}, 0
        self.heads = None if names is None else {f.removeprefix("^")[:3] for f in names}

    def numbers(self, words) -> tuple[int, ...]:
        out, heads, number = set(), self.heads, self.number
        for w in words:
            w = self.restorer.word(w)
            if heads is None or w[:3] in heads:
                out.update(map(number, features(w)))
        out.discard(None)
        return tuple(out)

    def described(self, token: str) -> tuple[str, tuple[int, ...], int]:
        """What a token encloses; the numbers of its features; and in the bits of one number (see unpacked) whether it is two
        plain letters or more, whether it may join with what is before and after, whether words that begin with it may
        have features, and the symbols of its first and last two letters."""
        core = token.strip(TRIM)
        plain = len(core) > 1 and core.isalpha() and not RUN3.search(core)
        joins = plain or bool(core) and all(c.isalpha() or c in LOOKS for c in core)
        ends = (symbol(core[0]) * SYMBOLS + symbol(core[1]), symbol(core[-2]) * SYMBOLS + symbol(core[-1])) if plain else (0, 0)
        # Of a short word, a run across its end may change the first three letters.
        heads = not plain or self.heads is None or len(core) < 3 or core[:3] in self.heads or len(core) < 5 and core[-1] == core[-2]
        bits = plain | (joins and token.startswith(core)) << 1 | (joins and token.endswith(core)) << 2 | heads << 3 | ends[0] << 4 | ends[1] << 16
        return token if core == token else core, self.numbers([token]), bits

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of all that occurs, each once, in order."""
        low = pc.utf8_lower(texts)
        more_at: list[int] = []
        more: list[int] = []

        def add(text: int, numbers: tuple[int, ...]) -> None:
            more.extend(numbers)
            more_at.extend([text] * len(numbers))

        maybe = pc.match_substring_regex(low, MAYBE_APART)
        apart = np.flatnonzero(maybe.to_numpy(zero_copy_only=False)).tolist()
        if apart:
            low = pc.replace_with_mask(low, maybe, pa.array([self.drawn(low[i].as_py(), lambda words, i=i: add(i, self.numbers(words))) for i in apart], low.type))
        counts, index, words = distinct_words(low, pc.utf8_split_whitespace)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        words = words.to_numpy(zero_copy_only=False).tolist()
        if self.held > self.MOST:
            self.known, self.held = {}, 0
        for w in words:
            if w not in self.known:
                self.known[w] = self.described(w)
                self.held += len(w)
        known = [self.known[w] for w in words]
        own = [x[1] for x in known]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        at = np.flatnonzero(sizes[index]) if len(own) else np.empty(0, np.int64)
        flat = np.array([n for x in own for n in x], np.int64)
        if len(index):
            for t, numbers in self.respaced(text, index, known):
                add(t, numbers)
        pairs = np.r_[np.repeat(text[at], sizes[index[at]]), np.array(more_at, np.int64)].astype(np.int64), np.r_[ragged(flat, np.cumsum(sizes) - sizes, sizes, index[at]), np.array(more, np.int64)]
        width = int(pairs[1].max(initial=0)) + 1
        return np.divmod(np.unique(pairs[0] * width + pairs[1]), width)

    def drawn(self, low: str, tell: Callable[[list[str]], None]) -> str:
        """low with a space between all letters that are set apart; tells what they are drawn together."""

        def apart(m):
            together = re.sub(r"[ .\-_*]", "", m[0])
            tell([*m[0].split(), *[together] * (not together.isdigit())])
            return " ".join(together)

        return APART.sub(apart, low)

    def respaced(self, text: np.ndarray, index: np.ndarray, known: list[tuple]):
        """(text, features) of what the best paths over the gaps of texts join or part. text, index: of each token."""
        plain, left, right, heads, head, tail = unpacked(np.array([x[2] for x in known], np.int32)[index])
        joins = left | right
        link = np.zeros(len(index) + 1, bool)  # link[i]: token i may join with the one before
        link[1:-1] = right[:-1] & left[1:] & (text[:-1] == text[1:])
        soft = np.zeros(len(index) + 1, bool)  # soft[i]: no plain space stands before token i

        i = np.flatnonzero(link[1:-1] & plain[:-1] & plain[1:]) + 1
        (a, b), (c, d), log = np.divmod(tail[i - 1], np.int16(SYMBOLS)), np.divmod(head[i], np.int16(SYMBOLS)), self.restorer.log
        soft[i] = log[a, b, c] + log[b, c, d] - COST_GAP > log[a, b, 0] + log[b, 0, c] + log[0, c, d]

        # Groups of pieces that aren't plain words, and how each reads between the words about it.
        inner = joins & ~plain
        starts = np.flatnonzero(inner & ~(link[:-1] & np.r_[False, inner[:-1]]))
        stops = np.flatnonzero(inner & ~(link[1:] & np.r_[inner[1:], False])) + 1
        before = np.where(link[starts] & plain[starts - 1], tail[starts - 1], -1)
        after = np.where(link[stops] & plain[np.minimum(stops, len(plain) - 1)], head[np.minimum(stops, len(plain) - 1)], -1)
        groups: dict[int, tuple[int, str]] = {}
        for s, e, x, y in zip(starts.tolist(), stops.tolist(), before.tolist(), after.tolist(), strict=True):
            if e - s == 1 and x < 0 and y < 0:
                continue  # on its own: read as a word
            pieces = tuple(known[k][0] for k in index[s:e].tolist())
            read, changed = self.restorer.stretch(divmod(x, SYMBOLS) if x >= 0 else (), pieces, divmod(y, SYMBOLS) if y >= 0 else ())
            if changed:
                groups[s] = e, read
                soft[s + (x < 0) : e + (y >= 0)] = True

        seen: dict[tuple, tuple[int, ...]] = {}
        first = np.flatnonzero(soft[1:] & ~soft[:-1])  # the token before the first soft gap
        last = np.flatnonzero(soft[:-1] & ~soft[1:])
        # Where plain words alone join, what they begin with tells whether the whole can have features.
        odd = np.cumsum(np.r_[False, ~plain])
        some = np.flatnonzero((odd[last + 1] > odd[first]) | heads[first])
        first, last = first[some], last[some]
        for s, e, t in zip(first.tolist(), last.tolist(), text[first].tolist(), strict=True):
            key = tuple(index[s : e + 1].tolist())
            numbers = seen.get(key)
            if numbers is None:
                out, k = [], s
                while k <= e:
                    stop, read = groups.get(k) or (k + 1, known[index[k]][0])
                    out.append(read)
                    k = stop
                numbers = seen[key] = self.numbers("".join(out).split())
            if numbers:
                yield t, numbers


def _present(batches, model):
    """(text, toxic) rows to (feature, toxic rows, rows)."""
    slots = Slots()
    finder = Finder(model, slots.__getitem__)
    for b in batches:
        text, found = finder(b.column(0))
        toxic = b.column(1).to_numpy(zero_copy_only=False)[text]
        names = list(slots)
        all_, toxic = np.bincount(found, minlength=len(names)), np.bincount(found, toxic, len(names)).astype(np.int64)
        some = np.flatnonzero(all_)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some.tolist()]), pa.array(toxic[some]), pa.array(all_[some])], names=["feature", "toxic", "total"])


def _indices(batches, model, index):
    finder = Finder(model, index.get)
    for b in batches:
        text, found = finder(b.column(0))
        lists = np.split(found.astype(np.int32), np.searchsorted(text, np.arange(1, b.num_rows))) if b.num_rows else []
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), b.column(1)], names=["found", "toxic"])


def fit(rows: list[tuple[list[int], int]], width: int, prior: float, rounds: int = 400, rate: float = 0.05, penalty: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with a quadratic penalty, by Adam steps over the whole sample. Weights are
    0 at least: what a text holds besides never takes evidence back, so long texts aren't scored lower. prior: the share of toxic rows among all labelled, to which the intercept of the stratified sample is set back."""
    if not rows or not width:
        return np.zeros(width), math.log(prior / (1 - prior))
    at = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    cols = np.array([c for f, _ in rows for c in f], np.int64)
    y = np.array([t for _, t in rows], float)
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(at, w[cols], len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.r_[np.bincount(cols, err[at], width) + penalty / len(rows) * w[:-1], err.sum()]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    return w[:-1], w[-1] + math.log(prior / (1 - prior)) - math.log(share / (1 - share))


class Scorer:
    _made: tuple[str, Scorer] | None = None

    def __init__(self, model: CharacterModel, weights: dict[str, float], bias: float):
        names = sorted(weights)
        self.weights, self.bias = np.array([weights[f] for f in names]), bias
        self.finder = Finder(model, {f: i for i, f in enumerate(names)}.get, names)

    @classmethod
    def shared(cls, key: str, counts: dict[int, int], weights: dict[str, float], bias: float) -> Scorer:
        """The scorer of a fit, with what it remembers, for all tasks of a process."""
        if cls._made is None or cls._made[0] != key:
            cls._made = key, cls(CharacterModel(counts), weights, bias)
        return cls._made[1]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The score of each text; a null one counts as empty."""
        text, found = self.finder(pc.fill_null(texts, ""))
        z = self.bias + np.bincount(text, self.weights[found], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[dict[int, int], dict[str, float], float]:
    """(trigram counts over all texts, weights, intercept). docs: doc_id, text; labels: doc_id, toxic.

    Labels of held-out rows and null labels are left out. The sample is the PER_CLASS rows of each label whose hashed
    ids are least. With no labelled row all scores are the prior, one half.
    """
    ship(spark)
    counts = docs.select("text").mapInArrow(_trigrams, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = {r.slot: r.n for r in counts.collect()}  # SYMBOLS**3 rows at most
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    toxic, total = known.agg(F.sum("toxic"), F.count("*")).first()
    prior = ((toxic or 0) + 1) / (total + 2)
    order = [F.xxhash64("_id"), "_id"]
    chosen = known.where("toxic = 1").orderBy(*order).limit(PER_CLASS).union(known.where("toxic = 0").orderBy(*order).limit(PER_CLASS))
    chosen = materialise(spark, chosen.groupBy("_id").agg(F.max("toxic").alias("toxic")), "chosen")  # 2 * PER_CLASS rows at most
    sample = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    sample = materialise(spark, sample.repartition(2 * spark.sparkContext.defaultParallelism), "sample")

    model = CharacterModel(counts)
    sent = spark.sparkContext.broadcast(model)
    seen = sample.mapInArrow(lambda it: _present(it, sent.value), "feature string, toxic long, total long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("total").alias("n")).where("n > 1")
    # How far the feature's toxic share lies from the sample's, in standard deviations.
    n_toxic, n_all = sample.agg(F.sum("toxic"), F.count("*")).first()
    p = max(1e-6, min(1 - 1e-6, (n_toxic or 0) / max(1, n_all)))
    z = (F.col("t") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    best = [r.feature for r in seen.where(z >= TELLING).orderBy(z.desc(), "feature").collect()]  # the bounded sample's
    index = {f: i for i, f in enumerate(best)}
    sent_index = spark.sparkContext.broadcast(index)
    rows = sample.mapInArrow(lambda it: _indices(it, sent.value, sent_index.value), "found array<int>, toxic int").collect()  # the bounded sample's
    rows = sorted((list(r.found), r.toxic) for r in rows)
    w, bias = fit(rows, len(best), prior)
    return counts, {f: float(x) for f, x in zip(best, w, strict=True) if x}, bias


def _scored(batches, fitted: tuple, at: int):
    scorer = Scorer.shared(*fitted)
    for b in batches:
        yield b, scorer(b.column(at))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, bar: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    A null text counts as empty; an empty text has the score of a text without any telling word. A null doc_id is not
    held out. Rows that repeat are scored each; empty tables give no rows; further columns are ignored whatever their
    names. Only the text is scored.
    """
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, *train(spark, held, labels)))

    def run(batches):
        for b, s in _scored(batches, sent.value, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= bar).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return held.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def clean_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, bar: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is bar or more."""
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, *train(spark, held, labels)))
    at = docs.columns.index(text_col)

    def run(batches):
        for b, s in _scored(batches, sent.value, at):
            yield b.filter(pa.array(s < bar))

    return docs.mapInArrow(run, docs.schema)

"""Pieces of DuckDB SQL that say what the column functions compute, written for the other engine."""

from __future__ import annotations

from ..functions import text as T
from .model import HEADS, TAILS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    """normalize() for the names of the model: each form once, and the one voiced pair of half-width kana that occurs."""
    for token, _ in T.CORP_FORMS:
        x = f"replace({x}, {lit(token)}, '')"
    x = f"replace({x}, 'ﾋﾞ', 'ビ')"
    x = f"translate({x}, {lit(T.WIDE + T.HALF_KANA)}, {lit(T.NARROW + T.FULL_KANA)})"
    x = f"translate({x}, {lit(T.SPACES + T.SIGNS)}, '')"
    x = f"translate({x}, {lit(T.HIRAGANA + T.OLD_KANJI)}, {lit(T.KATAKANA + T.NEW_KANJI)})"
    return f"upper({x})"


def grams(x: str, n: int = 2) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n})) WHEN length({x}) > 0 THEN [{x}] ELSE CAST([] AS VARCHAR[]) END"


def trigrams(x: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


#: DuckDB's levenshtein counts bytes, so characters of the model's names get one byte each first.
_CHARS = "".join(dict.fromkeys("".join([*HEADS, *TAILS]) + "カビンウツワミナトA株式会社有限(),ｶ"))
_WIDE_CHARS = "".join(c for c in _CHARS if ord(c) > 127)
_BYTES = "!#$%&*+,-./:;<=>?@^_`|~abcdefghijklmnopqrstuvwxyzBCDEFGHIJKLMNOPQRSTUVWXYZ"


def lev(a: str, b: str) -> str:
    one = lambda x: f"translate({x}, '{_WIDE_CHARS}', {lit(_BYTES[: len(_WIDE_CHARS)])})"
    return f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 ELSE 1 - levenshtein({one(a)}, {one(b)}) / greatest(length({a}), length({b}))::DOUBLE END"


def jac(a: str, b: str) -> str:
    """Of two gram lists."""
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def pre(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE len(list_filter(range(1, {n} + 1), lambda i: left({a}, i) = left({b}, i)))::DOUBLE / greatest(length({a}), length({b})) END"


def suf(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE len(list_filter(range(1, {n} + 1), lambda i: right({a}, i) = right({b}, i)))::DOUBLE / greatest(length({a}), length({b})) END"


def combined(w: tuple = (0.5, 0.3, 0.1, 0.1)) -> str:
    return f"100 * ({w[0]}::DOUBLE * levenshtein + {w[1]}::DOUBLE * jaccard + {w[2]}::DOUBLE * prefix + {w[3]}::DOUBLE * suffix) / ({w[0]}::DOUBLE + {w[1]}::DOUBLE + {w[2]}::DOUBLE + {w[3]}::DOUBLE)"


def metrics(a: str, b: str, ga: str, gb: str) -> str:
    return f"{lev(a, b)} AS levenshtein, {jac(ga, gb)} AS jaccard, {pre(a, b)} AS prefix, {suf(a, b)} AS suffix"

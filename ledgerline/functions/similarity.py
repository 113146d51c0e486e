"""Similarity of normalised names: edit distance, n-gram sets, common beginnings and ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of edit distance, n-gram overlap, common prefix and suffix.
WEIGHTS = (0.5, 0.3, 0.1, 0.1)


def _longest(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def levenshtein_sim(a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / _longest(a, b))


def jaccard_sim(grams_a: Column, grams_b: Column) -> Column:
    """Overlap of two gram arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(grams_a, grams_b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(grams_a, grams_b)) / union)


def prefix_sim(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer length; 0 where either is empty."""
    # The longest beginning of a that comes again right after the mark between the two.
    both = F.concat(F.translate(a, "\x00", "\ufffd"), F.lit("\x00"), F.translate(b, "\x00", "\ufffd"))
    common = F.length(F.regexp_extract(both, r"^([^\x00]*)[^\x00]*\x00\1", 1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(common / _longest(a, b))


def suffix_sim(a: Column, b: Column) -> Column:
    return prefix_sim(F.reverse(a), F.reverse(b))


def combine(lev: Column, jac: Column, pre: Column, suf: Column, weights=WEIGHTS) -> Column:
    """0 to 100. weights: numbers or Columns; where they add up to nothing the score is 0."""
    w = [x if isinstance(x, Column) else F.lit(float(x)) for x in weights]
    total = w[0] + w[1] + w[2] + w[3]
    score = 100 * (w[0] * lev + w[1] * jac + w[2] * pre + w[3] * suf) / total
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))


def set_similarity(shared: Column, n_a: Column, n_b: Column) -> Column:
    """Jaccard index from the size of the intersection."""
    return shared / (n_a + n_b - shared)

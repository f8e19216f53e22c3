"""Column expressions that Spark has no function for; all of them stay in the JVM (those with lambdas are evaluated there without generated code)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = frozenset("to in of on is it be by as at an or he a was its has for are the and with will were have this that from".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def bucket_number(value: Column, thresholds: list) -> Column:
    """How many of the ascending thresholds are at most value; null for null."""
    steps = F.lit(0)
    for t in thresholds:
        steps = steps + F.when(value >= F.lit(t), 1).otherwise(0)
    return F.when(value.isNotNull(), steps)


def simple_tokens(text: Column) -> Column:
    """Words in order with repeats: ASCII folded, split at ASCII signs, 2 to 100 bytes, no stop words."""
    words = F.split(F.translate(text, _UPPER, _LOWER), _SPLIT)
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & (F.octet_length(w) <= 100) & ~w.isin(*sorted(STOP_WORDS)))


def simple_tokens_of(text: str | None) -> list[str]:
    """``simple_tokens`` for one query string on the driver."""
    words = re.split("[^a-z0-9\x80-\U0010ffff]+", (text or "").translate(str.maketrans(_UPPER, _LOWER)))
    return [w for w in words if 2 <= len(w.encode()) <= 100 and w not in STOP_WORDS]


def trigrams(word: Column) -> Column:
    """Distinct trigrams of a lower-case word, padded by two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(word), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two words."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.lit(1.0) - dot(a, b) / norm)


def vector(values) -> Column:
    """A query vector as a literal."""
    return F.array(*[F.lit(float(v)) for v in values])

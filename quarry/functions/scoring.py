"""Scoring formulas as Column expressions; term frequency is binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# BM25 parameters, feature weights and freshness steps.
K1, B = 1.5, 0.75
WEIGHTS = {"bm25": 1.0, "phrase": 1.0, "title": 1.0, "url": 0.35, "pagerank": 0.15, "freshness": 0.08, "personal": 0.20}
FRESHNESS = ((30, 1.0), (365, 0.5))
STALE, FLOOR = 0.15, 0.05


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25f(n: Column, df: Column, length: Column, average: Column, boost: float = 1.0, tf: Column | float = 1.0) -> Column:
    tf = F.lit(float(tf)) if not isinstance(tf, Column) else tf
    norm = K1 * (1 - B + B * F.greatest(length, F.lit(1)) / F.greatest(average, F.lit(1.0)))
    return boost * idf(n, df) * tf * (K1 + 1) / (tf + norm)


def tfidf(n: Column, df: Column, boost: float = 1.0, tf: Column | float = 1.0) -> Column:
    """The alternative model: frequency times the same idf, whatever the field's length."""
    tf = F.lit(float(tf)) if not isinstance(tf, Column) else tf
    return F.when((df > 0) & (tf > 0), boost * tf * idf(n, df)).otherwise(0.0)


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def freshness(fetched_at: Column, as_of: Column) -> Column:
    """By whole days of age; no zone means UTC, the future counts as today, anything unreadable as 0."""
    at = F.try_to_timestamp(fetched_at)
    days = F.greatest(F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / 86_400_000_000), F.lit(0))
    out = F.when(at.isNull(), 0.0)
    for most, value in FRESHNESS:
        out = out.when(days <= most, value)
    return out.otherwise(STALE)


def total(features: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    out = F.lit(0.0)
    for k, c in features.items():
        out = out + weights[k] * c
    return out


def explain(features: dict[str, Column]) -> Column:
    return F.struct(*[F.bround(c, 6).alias(k) for k, c in features.items()])

"""Scores, bands and weights on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest good and largest acceptable value of each metric.
VITALS = {"lcp": (2500, 4000), "inp": (200, 500), "cls": (0.1, 0.25), "ttfb": (800, 1800)}


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def page_score(possible: Column, lost: Column) -> Column:
    return round_half_up(F.lit(100.0) * (possible - lost) / possible)


def vital_band(metric: str, value: Column) -> Column:
    good, poor = VITALS[metric]
    return F.when(value <= good, "good").when(value <= poor, "needsImprovement").when(value.isNotNull(), "poor")


def score_band(score: Column) -> Column:
    return F.when(score <= 49, "poor").when(score <= 89, "average").when(score.isNotNull(), "good")


def position_bucket(position: Column) -> Column:
    return F.when(position.isNull(), "none").when(position <= 3, "top3").when(position <= 10, "top10").when(position <= 20, "top20").otherwise("below")


def severity_weight(severity: Column) -> Column:
    return F.when(severity == "error", 10).when(severity == "warning", 3).when(severity == "notice", 1)


def baseline(relevance: Column, u: Column) -> Column:
    """The position that a page of this relevance starts from, given a random number in [0, 1)."""
    return F.greatest(F.lit(1), F.least(F.lit(100), round_half_up(3 + F.pow(1 - relevance, F.lit(1.5)) * 85 + u * 12)))


def idf(pages: Column, df: Column, anchored: Column) -> Column:
    """ln(1 + N / df) / ln(1 + N), softened for an anchored term that few pages hold; 1 for one page."""
    plain = F.log(1 + pages / df) / F.log(F.lit(1) + pages)
    return F.when(pages <= 1, F.lit(1.0)).when(anchored & (df <= 0.15 * pages), 1 - 0.5 * (1 - plain)).otherwise(plain)


def keyword_budget(words: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), 2 + F.floor(words / 400)))


def unscaled_cls(percentile: Column, first_bound: Column) -> Column:
    return F.when(first_bound <= 1, percentile).otherwise(percentile / 100)

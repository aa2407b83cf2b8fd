"""Content scores: headings, freshness, media, keywords, syllables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.numbers import below, clamp

#: Words that are not keywords.
NOT_KEYWORDS = ("the", "be", "to", "of", "and", "a", "in", "that", "have")


def heading_structure(h1: Column, h2: Column, h3: Column, h4: Column) -> Column:
    """100, less for a missing or repeated h1, skipped levels and too many h2 and h3."""
    score = (
        100.0
        - F.when(h1 == 0, 30.0).when(h1 > 1, 15.0).otherwise(0.0)
        - F.when((h2 > 0) & (h1 == 0), 20.0).otherwise(0.0)
        - F.when((h3 > 0) & (h2 == 0), 15.0).otherwise(0.0)
        - F.when((h4 > 0) & (h3 == 0), 10.0).otherwise(0.0)
        - F.when(h2 > 10, 10.0).otherwise(0.0)
        - F.when(h3 > 15, 10.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), score)


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000


def freshness_score(modified: Column, as_of: Column) -> Column:
    """From 100 for a week to a slow fall below 30 after a year; unknown dates score 0."""
    days = days_between(modified, as_of)
    old = F.greatest(F.lit(0.0), 30 - (days - 365) / 100)
    return F.when(modified.isNull(), 0.0).when(days <= 7, 100.0).when(days <= 30, 90.0).when(days <= 90, 75.0).when(days <= 180, 60.0).when(days <= 365, 40.0).otherwise(old)


def freshness_status(modified: Column, crawled: Column, as_of: Column) -> Column:
    """Label by whole days since the last change, or, if that is unknown, since the last crawl."""
    known = below(F.floor(days_between(modified, as_of)), [(7, "Very Fresh"), (30, "Fresh"), (90, "Moderately Fresh")], "Stale")
    guessed = below(F.floor(days_between(crawled, as_of)), [(7, "Potentially Fresh"), (30, "Potentially Moderately Fresh")], "Potentially Stale")
    return F.when(modified.isNotNull(), known).when(crawled.isNotNull(), guessed).otherwise("Unknown")


def media_richness(images: Column, videos: Column, interactive: Column) -> Column:
    return F.least(F.lit(100.0), F.least(F.lit(30.0), 5.0 * images) + F.least(F.lit(40.0), 10.0 * videos) + F.least(F.lit(30.0), 5.0 * interactive))


def content_quality(headings: Column, freshness: Column, media: Column, uniqueness: Column | None = None, grammar: Column | None = None) -> Column:
    """Weighted sum; uniqueness and grammar count as full unless given."""
    full = F.lit(100.0)
    return clamp(0.3 * headings + 0.25 * freshness + 0.15 * (full if uniqueness is None else uniqueness) + 0.15 * (full if grammar is None else grammar) + 0.15 * media)


def syllables(word: Column) -> Column:
    """Runs of one or two vowels."""
    return F.regexp_count(F.lower(word), F.lit("[aeiouy]{1,2}"))


def keyword_tokens(text: Column) -> Column:
    """Lower-case ASCII words of more than three characters that are not in the stop list."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1)), lambda w: (F.char_length(w) > 3) & ~w.isin(*NOT_KEYWORDS))

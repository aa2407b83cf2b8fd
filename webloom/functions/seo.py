"""Search scores of a page: thirteen parts from 0 to 1 and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.numbers import grade, half_up, ramp, ratio

#: Weights of the parts, in the order of their sum.
WEIGHTS = {
    "title": 10,
    "meta_description": 8,
    "url_structure": 7,
    "h1": 6,
    "content_length": 8,
    "content_quality": 9,
    "internal_linking": 7,
    "image_alt": 6,
    "page_speed": 9,
    "mobile": 8,
    "security": 7,
    "structured_data": 6,
    "social": 5,
}

#: Parts that are whole tenths, and so are their points.
TENTHS = ("url_structure", "content_quality")


def title(length: Column) -> Column:
    return ramp(F.nullif(length, F.lit(0)), 30, 60)


def meta_description(length: Column) -> Column:
    return ramp(F.nullif(length, F.lit(0)), 70, 155)


def content_length(words: Column) -> Column:
    return ramp(words, 300, 1500)


def internal_linking(links: Column) -> Column:
    return ramp(links, 2, 20)


def url_structure(url: Column) -> Column:
    """1, less for underscores, capitals, digits, long parts, parameters, depth and characters outside a-z, 0-9, '-' and '.' after the scheme."""
    parts = F.split(url, "/")
    rest = F.regexp_replace(url, r"^https?://", "")
    minus = (
        F.when(F.contains(url, F.lit("_")), 2).otherwise(0)
        + F.when(url.rlike("[A-Z]"), 2).otherwise(0)
        + F.when(url.rlike("[0-9]"), 1).otherwise(0)
        + F.when(F.exists(parts, lambda p: F.char_length(p) > 20), 2).otherwise(0)
        + F.when(url.rlike("[?&]"), 2).otherwise(0)
        + F.when(F.size(parts) > 4, 1).otherwise(0)
        + F.when(rest.rlike(r"[^a-z0-9.-]"), 2).otherwise(0)
    )
    return F.coalesce(F.greatest(F.lit(0), 10 - minus) / 10, F.lit(0.0))


def h1(length: Column) -> Column:
    return F.when(length.between(1, 70), 1.0).otherwise(0.5)


def content_quality(keyword: Column, title_: Column, description: Column, h1_: Column, h2_count: Column, h3_count: Column, images: Column, external_links: Column, words: Column) -> Column:
    """Points for the main keyword's places and for variety, less for short texts, within 0 to 1."""

    def has(text: Column) -> Column:
        return F.when((F.coalesce(keyword, F.lit("")) != "") & F.contains(F.lower(F.coalesce(text, F.lit(""))), keyword), 2).otherwise(0)

    def some(count: Column) -> Column:
        return F.when(count > 0, 1).otherwise(0)

    total = has(title_) + has(description) + has(h1_) + some(h2_count) + some(h3_count) + some(images) + some(external_links) - F.when(F.coalesce(words, F.lit(0)) < 300, 2).otherwise(0)
    return F.least(F.lit(10), F.greatest(F.lit(0), total)) / 10


def image_alt(with_alt: Column, total: Column) -> Column:
    return ratio(with_alt, total)


def page_speed(load_ms: Column) -> Column:
    """Step at 5000 ms, which is what the ramp with swapped bounds comes to."""
    return F.when(load_ms.isNull(), 0.0).otherwise(F.when(load_ms <= 5000, 1.0).otherwise(0.0))


def flag(value: Column) -> Column:
    return F.when(value, 1.0).otherwise(0.0)


def overall(parts: dict[str, Column]) -> Column:
    """Weighted mean in percent, rounded; a part that cannot be told counts as 0 with its full weight. Points in TENTHS are added as the nearest numbers to their tenths, so that
    what binary fractions leave over moves no sum across a half."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        if name in parts:
            points = F.coalesce(parts[name].cast("double"), F.lit(0.0)) * weight
            total = total + (F.round(points, 1) if name in TENTHS else points)
    return half_up(total / sum(WEIGHTS.values()) * 100)


def comment(score: Column) -> Column:
    return grade(score, [(90, "Excellent"), (80, "Very good"), (70, "Good"), (60, "Fair"), (50, "Needs improvement")], "Poor")


def security_flag(url: Column) -> Column:
    return flag(urls.scheme(url) == "https")

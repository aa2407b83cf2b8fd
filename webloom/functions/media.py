"""Image and link scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_score(alt: Column, size: Column, width: Column, height: Column, srcset: Column, loading: Column) -> Column:
    """100, less for no alternative text, size, missing dimensions (0 is missing too), no set of sources for a wide or high image,
    and no loading attribute."""
    return F.greatest(
        F.lit(0),
        100
        - F.when(F.coalesce(alt, F.lit("")) == "", 30).otherwise(0)
        - F.when(size > 200000, 20).when(size > 100000, 10).otherwise(0)
        - F.when((F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0), 15).otherwise(0)
        - F.when(F.coalesce(srcset, F.lit("")) == "", F.when((width > 800) | (height > 800), 15).otherwise(0)).otherwise(0)
        - F.when(F.coalesce(loading, F.lit("")) == "", 10).otherwise(0),
    )


def image_optimization(size: Column) -> Column:
    return F.when(size > 200000, "Low").when(size > 100000, "Medium").otherwise("High")


def alt_text_score(alt: Column) -> Column:
    return F.least(F.lit(100), 5 * F.char_length(F.coalesce(alt, F.lit(""))))


def link_score(text: Column, status: Column, redirects: Column) -> Column:
    """100, less for an empty or generic text, an error status, and every redirect from the second on."""
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.greatest(
        F.lit(0),
        100 - F.when((plain == "") | F.contains(plain, F.lit("click here")), 20).otherwise(0) - F.when(status >= 400, 50).otherwise(0) - F.when(redirects > 1, 10 * redirects).otherwise(0),
    )

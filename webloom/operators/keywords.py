"""Main keyword and top keywords of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.content import keyword_tokens
from webloom.session import ship


def main_keyword(text: Column) -> Column:
    """Most frequent lower-case ASCII word of a short text, the first seen on a tie; within the row, no shuffle."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), F.lit(1))
    counted = F.transform(F.array_distinct(words), lambda w: F.struct(F.size(F.filter(words, lambda x: x == w)).alias("n"), (-F.array_position(words, w)).alias("p"), w.alias("w")))
    return F.array_max(counted)["w"]


def top_keywords(rows: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(key, rank, word, n) of the ``n`` most frequent keywords of each row's text; ties by first position.

    All within the row, without a shuffle: words are found by expressions and counted in Arrow batches in time linear in their number, as expressions over arrays
    look up each word's place anew."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<struct<word:string,n:bigint>>")
    def most_frequent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda w: [{"word": x, "n": k} for x, k in Counter(w).most_common(n)])

    words = rows.select(key, keyword_tokens(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    best = words.select(key, F.posexplode(most_frequent("_w")).alias("_at", "_b"))
    return best.select(key, F.col("_b.word").alias("word"), F.col("_b.n").alias("n"), (F.col("_at") + 1).alias("rank"))

"""A training-corpus pipeline of five of the library's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's result is
written as Parquet and read again as the next stage's docs, so each stage starts from stored rows and its decisions take effect."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import contamination, neardup, packing, pii, quality
from webloom.llm.common import table
from webloom.llm.queries import BPE, checksums
from webloom.storage import discard, materialize, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.3), learned from the labels outside the held-out fold. Null and empty texts
    have the score of the bias; equal texts equal scores, so repeated rows stay or go together; no documents give none."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~quality.held_out()))
    return quality.score(docs, model, COLUMNS).filter("score >= 0.3").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number of their own in _row, whatever their ids, stored so that it stays the same."""
    return materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")


@contextmanager
def working_tables() -> Iterator[list[DataFrame]]:
    """What is written inside is deleted at the end, but for the tables in the list."""
    kept: list[DataFrame] = []
    with scratch(kept):
        yield kept


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id (five-word shingles, similarity 0.8).

    Rows are compared and dropped one by one: different texts that share an id are different documents, and rows with a null id take
    part (one is kept where its class has no id). Blank texts are like no other; equal rows of them with one id are one."""
    rows = numbered(docs)
    with working_tables() as kept:
        found = neardup.near_duplicates(rows, width=5, percent=80, key="_row").select(F.col("doc_id").alias("_row"), "n_shingles", "component_id")
        visible = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        ids = rows.select("_row", "doc_id", F.when(~visible, F.col("text")).alias("_blank"))
        empty = F.col("n_shingles") == 0
        classes = found.join(ids, "_row").groupBy(F.when(~empty, F.col("component_id")).alias("_class"), F.when(empty, F.col("doc_id")).alias("_id"), F.when(empty, F.col("_blank")).alias("_text"))
        least = classes.agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row")).alias("least")).select("least._row")
        kept.append(materialize(least, "kept"))
    return rows.join(kept[0], "_row", "left_semi").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share too little with the benchmark to count as contaminated, decided row by row, whatever their ids. Null and empty
    texts share nothing and stay; repeated rows stay or go together."""
    rows = numbered(docs)
    with working_tables() as kept:
        found = contamination.digest(contamination.contamination(rows, table(spark, sf_dir, "benchmark"), key="_row"))
        kept.append(materialize(found.filter("contaminated").select(F.col("doc_id").alias("_row")), "contaminated"))
    return rows.join(kept[0], "_row", "left_anti").select(*COLUMNS)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind. A null text stays null, with null characters; repeated rows and
    null ids are rewritten each."""
    clean = pii.private_data(docs, columns=["doc_id", "lang", "source"], redacted=True)
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.char_length("redacted").cast("bigint").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 ids: one row per piece. A null or empty text is the end id alone."""
    return checksums(packing.pack_online(docs, public_tokenizers.path(BPE), capacity=1024))


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("personal data", without_private_data),
    ("packing", packed),
]

#: Trained weights, sketches and token ids cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``. A stage's working tables, and the documents it read, go once its own are stored."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with working_tables() as kept:
            kept.append(materialize(stage(spark, docs, sf_dir), f"stage{k}"))
        discard(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)

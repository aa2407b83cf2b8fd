"""One query per training-data operator, over whole tables with production parameters.

Every query gives one row per row of its table (op3: per packed sequence, op4 and op13: per piece), for empty tables none; what a null, an empty text, a tie or a
repeated row gives is said by the operator's function. SQL for a second engine is in webloom.llm.oracle, for those that SQL can
express; trained weights, token ids, sounds and markup cannot be written there, and tests hold those queries against brute force."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import audio, contamination, fill_middle, html_text, neardup, packing, pii, quality, repacking, sharding, suffix_dedup, vector_codes
from webloom.llm.common import releasing, table
from webloom.llm.oracle import ORACLE_SQL
from webloom.llm.tokens import stored_type

BPE, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored sound, and digests of what was read back. A null text is an empty one."""
    return audio.media_features(table(spark, sf_dir, "documents"))


def op2_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts, learned outside the held-out fold. Null and empty texts get the score of the bias."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bfd_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed matrices of 2048 ids a row, a document closed by the end id. A null text is that id alone."""
    return packing.pack_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), capacity=2048)


def op4_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packing.pack_online with a checksum in place of the ids."""
    return checksums(packing.pack_online(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), capacity=1024))


def checksums(pieces: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces with the crc32 of their ids, as little-endian unsigned 32-bit numbers, in place of the ids.

    ``tokenizer`` is the vocabulary file that the ids are from (default: the queries' one); it says how they are stored. Repeated rows and null
    keys are passed on; no rows give no rows."""
    stored = stored_type(tokenizer or public_tokenizers.path(BPE))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(ids.as_buffer(), stored).astype("<u4").tobytes()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length")), pa.array(sums, pa.int64()), *(batch.column(c) for c in ("doc_tokens", "sequence_id", "offset"))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return pieces.mapInArrow(releasing(digest), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op5_jump_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by key. A null key counts as 0, a null text has no bytes; equal rows get a slot each."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op6_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest, and all spans. A null text has none."""
    found = pii.private_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in documents. Null texts have no words; items of one id count once."""
    return contamination.digest(contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_cover_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents without strings of earlier ones. Null texts are empty; rows of one id never cut each other."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50))


def op9_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages. A null or text-free page has an empty one; repeated rows are extracted each."""
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op10_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes. Null, empty and blank texts are linked with nothing; a null id is its own class; rows of one id are compared each by its own text."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_chunked_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut by lines into prefix, middle and suffix, and digests of the output and of the text rebuilt from it. A null or empty text is plain."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), unit="line", seed=7, rate=100, spm=50)
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (fill_middle.restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all whole and finite vectors. Equal distances take the lower entry, null labels are one label."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op13_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in few sequences. A null text is the end id alone; repeated rows are packed each."""
    packed = repacking.pack_certified(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_audio_features, op2_ftrl_quality, op3_bfd_matrices, op4_online_packing, op5_jump_shard, op6_weak_pii, op7_positional_index, op8_cover_suffix_dedup, op9_block_rules, op10_fast_sketch_dedup, op11_chunked_fim, op12_annular_codes, op13_certified_packing)
}

__all__ = ["BPE", "ORACLE_SQL", "QUERIES", "checksums"]

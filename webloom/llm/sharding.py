"""Sharding by jump consistent hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published jump consistent hash: multiplier of its generator, bits kept, and the step's numerator.
MULTIPLIER, KEPT, STEP = "2862933555777941757", "8589934592", "2147483648"


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """Shard of ``key`` (an integer of up to 64 bits; null counts as 0) among ``shards``, and among ``shards + 1``.

    The jumps follow one key's sequence of growing shard numbers, so both come from one walk: adding a shard moves a key
    into the new shard or not at all. Spark checks overflow of 64-bit products, so the generator's state is a decimal."""
    start = F.struct(
        F.pmod(F.coalesce(key.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), F.expr("18446744073709551616BD")).cast("decimal(38,0)").alias("k"),
        F.lit(0).cast("bigint").alias("j"),
        F.lit(-1).alias("small"),
        F.lit(-1).alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        k = F.when(s.j > shards, s.k).otherwise(((s.k * F.expr(f"{MULTIPLIER}BD") + F.expr("1BD")) % F.expr("18446744073709551616BD")).cast("decimal(38,0)"))
        grown = F.when(s.j > shards, s.grown).otherwise(s.j.cast("int"))
        small = F.when(s.j >= shards, s.small).otherwise(s.j.cast("int"))
        top = (k - k % F.expr(f"{KEPT}BD")) / F.expr(f"{KEPT}BD")
        j = F.when(s.j > shards, s.j).otherwise(F.floor((grown + 1).cast("double") * (F.lit(float(STEP)) / (top.cast("double") + 1))).cast("bigint"))
        return F.struct(k.alias("k"), j.alias("j"), small.alias("small"), grown.alias("grown"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)
    return walked["small"], walked["grown"]


#: Rows that a range of slots holds at least, on average.
RANGE_ROWS = 4096

#: Equal rows that one row stands for at most when slots are given out.
PIECE = 1 << 16


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Give every row a shard by its key alone and a gapless slot within that shard.

    Columns returned: ``key``, size (UTF-8 bytes + 1; a null text has none), text_crc32, law ('key'), shard, slot, grown_shard
    (the shard if there was one more). Integer keys are hashed as they are, keys of any other type by the xxhash64 of their text; a null key
    counts as 0, rows with equal keys share a shard, an empty table gives no rows; other columns are not looked at.

    Texts are read once and leave the plan before the first exchange; rows that are equal in all that is left become one row with a count, and a large count becomes
    pieces of at most PIECE rows. Slots run through ranges that a hash of the row and its piece picks, however the keys are spread and however many rows are equal; about the
    square root of all rows are in each, and only the ranges' counts meet in the window that makes running offsets."""
    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    narrow = docs.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    n = docs.count()
    ranges = max(1, n // int(max(RANGE_ROWS, n**0.5)))
    own = ["shard", "grown_shard", "_key", "size", "text_crc32"]
    number = F.col("_key") if whole else F.when(F.col("_key").isNotNull(), F.xxhash64(F.col("_key").cast("string")))
    small, grown = jump_hash(number, shards)
    rows = narrow.withColumn("_walk", F.struct(small.alias("s"), grown.alias("g"))).select("_key", "size", "text_crc32", F.col("_walk.s").alias("shard"), F.col("_walk.g").alias("grown_shard"))
    kinds = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_all")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_all") - 1) / PIECE))).alias("_piece"))
    kinds = kinds.select(*own, "_piece", F.least(F.lit(PIECE).cast("bigint"), F.col("_all") - F.col("_piece") * PIECE).alias("_n"), F.pmod(F.xxhash64("_key", "size", "text_crc32", "_piece"), F.lit(ranges)).alias("_range"))
    counts = kinds.groupBy("shard", "_range").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_range").orderBy("_key", "text_crc32", "size", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = kinds.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(offsets, ["shard", "_range"])
    return first.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(F.col("_before") + F.col("_at"), F.col("_before") + F.col("_at") + F.col("_n") - 1)).alias("slot"), "grown_shard"
    )

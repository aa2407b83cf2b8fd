"""Cached pages as a stored table: one bucket of addresses a folder, so that joins by address need no exchange and changes rewrite the buckets they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls

#: Columns of a cached page. ``key`` is the MD5 digest of the address, ``bucket`` the bucket that Spark puts the address in.
COLUMNS = "key string, html string, status_code int, last_modified timestamp, last_crawled timestamp, data string"


def bucket_of(url: Column, buckets: int) -> Column:
    """The bucket that Spark's bucketed tables give an address."""
    return F.pmod(F.hash(url), F.lit(buckets))


class PageCache:
    """A table of pages by address under ``path``, named ``name`` in the session's catalog.

    The table is bucketed by url, and partitioned by the same bucket number. Bucketing tells Spark how rows lie, so joins and groupings by url with another table of as many
    buckets read each bucket where it is; the partitions let a change replace whole buckets and leave the others' files alone. What comes in twice for an address is
    decided by the later crawl, on a tie by the greater content. Texts are stored as they come."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64) -> None:
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} (url string, {COLUMNS}, bucket int) USING parquet PARTITIONED BY (bucket) CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{self.path}'")
            folder, store = self._folder(self.path)
            store.mkdirs(folder)
            spark.catalog.recoverPartitions(name)

    def _folder(self, path: str):
        """A folder and its file system, wherever Spark can write."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self) -> DataFrame:
        """All cached pages as stored."""
        return self.spark.table(self.name)

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """Cached pages, or those whose url is in ``wanted``; only that side is exchanged. A page stored without a status counts as 200, and one whose address is no
        web address as not there."""
        rows = self.table().filter(urls.is_valid(F.col("url"), all_languages=True)).withColumn("status_code", F.when(F.coalesce("status_code", F.lit(0)) == 0, 200).otherwise(F.col("status_code")))
        if wanted is not None:
            rows = rows.join(wanted.select("url").distinct(), "url", "left_semi")
        return rows.drop("bucket")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of these addresses, at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(bucket_of(F.col("url"), self.buckets)).distinct().collect())

    def _replace(self, rows: DataFrame) -> None:
        """Make ``rows`` all that their buckets have. New files are complete before old ones go."""
        mode = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            rows.select(*self.table().columns).write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        self.spark.catalog.refreshTable(self.name)

    def write(self, pages: DataFrame) -> list[int]:
        """Store pages (url and any of COLUMNS but the key), one an address, over older crawls. Returns the buckets that were rewritten: none where all is there already.
        Rows without an address are dropped."""
        own = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = {c.split()[0]: c.split()[1] for c in COLUMNS.split(", ")}
        given = set(pages.columns)
        new = pages.filter(F.col("url").isNotNull()).select(
            "url", *[(urls.cache_key(F.col("url")) if c == "key" else F.col(c).cast(kinds[c]) if c in given else F.lit(None).cast(kinds[c])).alias(c) for c in own], bucket_of(F.col("url"), self.buckets).alias("bucket")
        )
        rest = [c for c in self.table().columns if c not in ("url", "bucket")]
        newest = F.max(F.struct(F.col("last_crawled"), F.md5(F.coalesce("html", F.lit(""))).alias("_digest"), *[F.col(c) for c in rest if c != "last_crawled"])).alias("_row")
        one = lambda rows: rows.groupBy("url", "bucket").agg(newest).select("url", *[f"_row.{c}" for c in rest], "bucket")
        changed = one(new).join(self.table().select("url", *[F.col(c).alias(f"_{c}") for c in rest]), "url", "left")
        same = F.lit(True)
        for c in rest:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        older = F.col("_key").isNotNull() & (F.col("last_crawled") < F.col("_last_crawled"))
        touched = self._touched(changed.filter(~(same | F.coalesce(older, F.lit(False)))))
        if touched:
            both = self.table().filter(F.col("bucket").isin(touched)).unionByName(new.filter(F.col("bucket").isin(touched)))
            self._replace(one(both))
        return touched

    def stale(self, sources: DataFrame) -> DataFrame:
        """(url) of cached pages whose source (url, last_modified) changed after they were crawled. A source without a date says nothing."""
        changed = sources.groupBy("url").agg(F.max("last_modified").alias("_changed"))
        return self.table().select("url", "last_crawled").join(changed, "url").filter("_changed > last_crawled").select("url")

    def invalidate(self, gone: DataFrame) -> list[int]:
        """Drop the pages of these addresses, and return the buckets rewritten for it; a bucket that is left empty loses its folder."""
        hit = self.table().select("url", "bucket").join(gone.select("url").distinct(), "url", "left_semi")
        touched = sorted(r[0] for r in hit.select("bucket").distinct().collect())
        if not touched:
            return []
        kept = self.table().filter(F.col("bucket").isin(touched)).join(gone.select("url").distinct(), "url", "left_anti")
        full = {r[0] for r in kept.select("bucket").distinct().collect()}
        empty = [b for b in touched if b not in full]
        if full:
            self._replace(kept)
        for b in empty:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (bucket = {b})")
            folder, store = self._folder(f"{self.path}/bucket={b}")
            store.delete(folder, True)
        self.spark.catalog.refreshTable(self.name)
        return touched

    def refresh(self, pages: DataFrame, sources: DataFrame) -> list[int]:
        """Invalidate what is stale by ``sources``, then store ``pages``."""
        dropped = self.invalidate(self.stale(sources))
        return sorted({*dropped, *self.write(pages)})

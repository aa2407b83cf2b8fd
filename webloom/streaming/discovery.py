"""Incremental discovery: pages come as a stream, and what they link to that the sitemap lacks goes out, each link once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import links
from webloom.session import ship


def new_links(pages: DataFrame, sitemap: DataFrame, late: str = "1 day", ts: str = "fetched_at") -> DataFrame:
    """(source_url, target_url, ts): links within a host to addresses that ``sitemap`` (a table, read anew with each batch) lacks, without fragment and query.

    ``pages``: url, html and an event time. On a stream a link is put out when it is first seen; it counts as seen for ``late`` after it was, in event time, so state is bounded by
    what is fetched in that time. A page later than ``late`` behind the newest is dropped. What is put out is only added to, so any sink will do; a link that comes again after
    ``late`` comes out again, and ``discovered`` counts it once. On a table all links come out once."""
    ship(pages.sparkSession)
    rows = pages.select(ts, "url", "html")
    if pages.isStreaming:
        rows = rows.withWatermark(ts, late)
    found = rows.select(ts, F.col("url").alias("source_url"), F.explode(links.markup.hrefs(F.col("html"))).alias("_href"))
    found = found.withColumn("target_url", links.resolve(F.col("_href"), F.col("source_url"))).filter(F.col("target_url").isNotNull())
    found = found.filter(urls.host(F.col("source_url")) == urls.host(F.col("target_url"))).select(ts, "source_url", urls.without_query(F.col("target_url")).alias("target_url"))
    missing = found.join(sitemap.select(F.col("url").alias("target_url")).distinct(), "target_url", "left_anti").select("source_url", "target_url", ts)
    if pages.isStreaming:
        return missing.dropDuplicatesWithinWatermark(["source_url", "target_url"])
    return missing.groupBy("source_url", "target_url").agg(F.min(ts).alias(ts))


def discovered(found: DataFrame) -> DataFrame:
    """(url, pages) of what ``new_links`` put out so far: how many pages link to each address."""
    return found.groupBy(F.col("target_url").alias("url")).agg(F.count_distinct("source_url").alias("pages"))


def follow(pages: DataFrame, sitemap: DataFrame, path: str, late: str = "1 day", ts: str = "fetched_at", once: bool = True):
    """Write new links of a stream as Parquet below ``path``, with the checkpoint beside them, and return the running query. It goes on where it stopped: files of a batch
    that was not finished are not read. With ``once`` it ends when all that is there has been read."""
    writer = new_links(pages, sitemap, late, ts).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/links")
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_links(spark: SparkSession, path: str, ts: str = "fetched_at") -> DataFrame:
    """The links that ``follow`` has written."""
    return spark.read.schema(f"source_url string, target_url string, {ts} timestamp").parquet(f"{path}/links")

"""The link graph: links as rows, what the sitemap misses, orphans, reachability."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import markup, urls
from webloom.session import ship
from webloom.storage import materialize


def resolve(href: Column, page: Column) -> Column:
    """Absolute form of a target as a page gives it; null for fragments, scripts, mail and the like."""
    base = F.regexp_replace(urls.path(page), r"[^/]*$", "")
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(urls.scheme(page), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(urls.origin(page), href))
        .when(F.startswith(href, F.lit("?")), F.concat(urls.origin(page), urls.path(page), href))
        .otherwise(F.concat(urls.origin(page), base, href))
    )
    useless = (F.coalesce(href, F.lit("")) == "") | href.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:(?!//))")
    return F.when(~useless, joined)


def explode_links(pages: DataFrame) -> DataFrame:
    """(source_url, position, href, target_url) of every anchor with a usable target, native all the way."""
    rows = pages.select(F.col("url").alias("source_url"), F.posexplode(markup.hrefs(F.col("html"))).alias("position", "href"))
    return rows.withColumn("target_url", resolve(F.col("href"), F.col("source_url"))).filter(F.col("target_url").isNotNull())


def internal(links: DataFrame) -> DataFrame:
    """Links within a host, without fragment and query, the first of each target on a page."""
    same = links.filter(urls.host(F.col("source_url")) == urls.host(F.col("target_url"))).withColumn("target_url", urls.without_query(F.col("target_url")))
    return same.groupBy("source_url", "target_url").agg(F.min("position").alias("position"))


def discovered(links: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Targets that the sitemap lacks, with the number of pages that link to each."""
    missing = links.join(sitemap.select(F.col("url").alias("target_url")).distinct(), "target_url", "left_anti")
    return missing.groupBy(F.col("target_url").alias("url")).agg(F.count_distinct("source_url").alias("pages"))


def orphans(sitemap: DataFrame, links: DataFrame) -> DataFrame:
    """Sitemap URLs that no page links to (a page's link to itself does not count)."""
    inbound = links.filter("source_url <> target_url").select(F.col("target_url").alias("url")).distinct()
    return sitemap.select("url").distinct().join(inbound, "url", "left_anti")


def perfected_sitemap(sitemap: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """Every URL of the sitemap, the crawl and the links once; ``discovered`` marks those that the sitemap lacks."""
    every = sitemap.select("url", F.lit(False).alias("discovered")).unionByName(pages.select("url", F.lit(True).alias("discovered"))).unionByName(links.select(F.col("target_url").alias("url"), F.lit(True).alias("discovered")))
    return every.groupBy("url").agg(F.min("discovered").alias("discovered"))


#: Frontiers that are kept as tables of their own before they become one.
FRONTIERS = 16


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """(url, depth): breadth-first distance from the seeds over (source, target) edges, until nothing new is found, or ``depth`` steps, or ``limit``
    addresses (of the last step the first in code-point order).

    A round joins the last frontier with the edges and drops what was seen. Frontiers are stored, and every FRONTIERS of them become
    one table, so plans stay short however deep the site is."""
    ship(edges.sparkSession)
    frontier = materialize(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    parts, count, step = [frontier], frontier.count(), 0
    while (depth is None or step < depth) and (limit is None or count < limit):
        step += 1
        after = edges.join(frontier.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).filter("url is not null").distinct()
        for part in parts:
            after = after.join(part.select("url"), "url", "left_anti")
        frontier = materialize(after.withColumn("depth", F.lit(step)), "frontier")
        found = frontier.count()
        if not found:
            break
        if limit is not None and count + found > limit:
            frontier = materialize(frontier.orderBy("url").limit(limit - count), "frontier")
        count += found
        parts.append(frontier)
        if len(parts) > FRONTIERS:
            merged = materialize(_union(parts), "frontier")
            parts = [merged]
    return _union(parts)


def reachable_sql(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(url, depth) as ``reachable`` has it within ``depth`` steps, by a recursive query. A step joins the rows of the step before, each address once, with all edges; an address found again
    later is found again, so this is for small depths."""
    spark = edges.sparkSession
    names = [f"reach_{kind}_{uuid.uuid4().hex}" for kind in ("edges", "seeds")]
    edges.select("source", "target").filter("target is not null").distinct().createOrReplaceTempView(names[0])
    seeds.select("url").distinct().createOrReplaceTempView(names[1])
    found = spark.sql(
        f"WITH RECURSIVE reach(url, depth) MAX RECURSION LEVEL {depth + 2} AS (SELECT url, 0 FROM {names[1]} UNION ALL "
        f"SELECT DISTINCT e.target, r.depth + 1 FROM reach r JOIN {names[0]} e ON e.source = r.url WHERE r.depth < {int(depth)}) SELECT url, min(depth) AS depth FROM reach GROUP BY url"
    )
    for name in names:
        spark.catalog.dropTempView(name)
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rank_by_position(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)

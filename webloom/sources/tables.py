"""Readers: stored tables, sitemaps, text files, run histories and thresholds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import urls
from webloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named Parquet table of a data folder; filters and columns reach the scan."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_URL = (
    "loc string, lastmod string, changefreq string, priority double, `image:image` array<struct<`image:loc`:string,`image:caption`:string,`image:title`:string>>, "
    "`news:news` array<struct<`news:publication`:struct<`news:name`:string>,`news:publication_date`:string,`news:title`:string>>"
)


def sitemap(spark: SparkSession, path: str, all_languages: bool = False, base: str | None = None) -> DataFrame:
    """Entries of urlset files (also .gz): url, lastmod, changefreq, priority, images, news. Entries without a location are dropped, others by language
    unless ``all_languages``; with ``base`` its home page, robots.txt and llms.txt come first with priorities 1, 0.9 and 0.8."""
    raw = spark.read.format("xml").option("rowTag", "url").schema(_URL).load(path)
    image, news = F.col("`image:image`"), F.col("`news:news`")
    rows = raw.select(
        F.trim("loc").alias("url"),
        "lastmod",
        "changefreq",
        "priority",
        F.transform(image, lambda i: F.struct(i["image:loc"].alias("loc"), i["image:caption"].alias("caption"), i["image:title"].alias("title"))).alias("images"),
        F.transform(news, lambda n: F.struct(n["news:publication"]["news:name"].alias("publication"), n["news:publication_date"].alias("publication_date"), n["news:title"].alias("title"))).alias("news"),
    ).filter(F.coalesce(F.col("url"), F.lit("")) != "")
    if not all_languages:
        rows = rows.filter(urls.language_allowed(F.col("url"), letters_only=False, ignore_case=False))
    if base:
        home = base.rstrip("/")
        extra = spark.createDataFrame([(f"{home}/", None, "daily", 1.0, None, None), (f"{home}/robots.txt", None, "daily", 0.9, None, None), (f"{home}/llms.txt", None, "daily", 0.8, None, None)], schemas.SITEMAP_URLS)
        rows = extra.unionByName(rows)
    return rows


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """Locations of the sitemaps that index files name; reading those is one more call of ``sitemap`` with all their paths."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(path).select(F.trim("loc").alias("url"), "lastmod").filter("url <> ''")


def sitemap_from_pages(pages: DataFrame, base: str) -> DataFrame:
    """Entries from the links of HTML pages of one host, where there is no XML."""
    from webloom.operators.links import explode_links

    targets = explode_links(pages).select(urls.without_query(F.col("target_url")).alias("url")).filter(urls.host(F.col("url")) == urls.host(F.lit(base))).distinct()
    return targets.select("url", F.lit(None).cast("string").alias("lastmod"), F.lit("daily").alias("changefreq"), F.lit(0.7).alias("priority"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, content) of whole text files such as robots.txt and llms.txt."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("content"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs as rows of RUN_METRICS; unreadable lines are left out, and runs of another major or minor schema version too. Runs
    stored without a site are one site's."""
    raw = spark.read.schema(f"{schemas.RUN_METRICS}, schema_version string, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.filter(F.col("_corrupt").isNull() & compatible(F.col("schema_version"))).drop("_corrupt").fillna("", ["site"])


def compatible(version, current: str = schemas.SCHEMA_VERSION):
    """Same major and minor number."""
    return F.coalesce(F.slice(F.split(version, r"\."), 1, 2) == F.slice(F.split(F.lit(current), r"\."), 1, 2), F.lit(False))


def fresh(cache: DataFrame, sources: DataFrame) -> DataFrame:
    """Cached pages whose source is not known to have changed since they were crawled (both by url)."""
    stale = cache.join(sources.select("url", F.col("last_modified").alias("_changed")), "url").filter("_changed > last_crawled").select("url")
    return cache.join(stale, "url", "left_anti")


#: Limits used where a thresholds file has none: category, metric, direction, pass and warn.
THRESHOLDS = [
    ("performance", "load_time", False, 3000.0, 5000.0),
    ("performance", "lcp", False, 2500.0, 4000.0),
    ("performance", "fcp", False, 1800.0, 3000.0),
    ("performance", "cls", False, 0.1, 0.25),
    ("accessibility", "max_errors", False, 0.0, 5.0),
    ("accessibility", "max_warnings", False, 10.0, 25.0),
    ("seo", "min_score", True, 80.0, 60.0),
    ("llm", "min_served", True, 70.0, 50.0),
    ("llm", "min_rendered", True, 70.0, 50.0),
]


def validate_thresholds(rows: list[tuple[str, str, bool, float, float]]) -> list[str]:
    """What is wrong with a list of thresholds: a warning limit on the wrong side of the passing one, or a negative limit."""
    wrong = []
    for category, metric, higher, good, fair in rows:
        if (fair > good) if higher else (fair < good):
            wrong.append(f"{category}.{metric}: warn {fair} is on the wrong side of pass {good}")
        if min(good, fair) < 0:
            wrong.append(f"{category}.{metric}: limits must not be negative")
    return wrong


def thresholds(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Thresholds of a JSON file {category: {metric: {pass, warn}}} over the defaults; a file with wrong limits is refused."""
    rows = {(c, m): (c, m, h, p, w) for c, m, h, p, w in THRESHOLDS}
    if path:
        text = spark.read.option("wholetext", True).text(path).first()[0]
        for category, metrics in json.loads(text).items():
            for metric, limits in metrics.items():
                higher = rows[category, metric][2] if (category, metric) in rows else category not in ("performance", "accessibility")
                rows[category, metric] = (category, metric, higher, float(limits["pass"]), float(limits["warn"]))
    if wrong := validate_thresholds(list(rows.values())):
        raise ValueError("; ".join(wrong))
    return spark.createDataFrame(list(rows.values()), schemas.THRESHOLDS)

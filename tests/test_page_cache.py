"""The stored page cache: upserts, reads without an exchange, invalidation, and what a rerun leaves alone."""

import hashlib
import os
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webloom.sources.page_cache import PageCache


def pages(spark, rows):
    return spark.createDataFrame([(u, h, s, datetime(2024, 1, d)) for u, h, s, d in rows], "url string, html string, status_code int, last_crawled timestamp")


@pytest.fixture
def make(spark, tmp_path):
    made = []

    def cache(name=None, folder="cache", buckets=8):
        made.append(name or f"cache_{uuid.uuid4().hex}")
        return PageCache(spark, made[-1], str(tmp_path / folder), buckets)

    yield cache
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def files(cache):
    return {(d, f, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(cache.path) for f in names if f.endswith(".parquet")}


def stored(cache):
    return {r["url"]: r["html"] for r in cache.read().collect()}


ROWS = [(f"https://a.com/{k}", f"<p>{k}</p>", 200, 1) for k in range(40)]


def test_upserts_keep_the_latest_crawl(spark, make):
    cache = make()
    cache.write(pages(spark, ROWS))
    assert stored(cache) == {u: h for u, h, *_ in ROWS}
    again = [("https://a.com/1", "new", 200, 5), ("https://a.com/1", "newer", 404, 6), ("https://a.com/2", "older", 200, 1), (None, "x", 200, 1), ("https://a.com/new", None, None, 2)]
    assert len(cache.write(pages(spark, again))) <= 3
    found = {r["url"]: r for r in cache.read().collect()}
    assert len(found) == 41 and found["https://a.com/1"]["html"] == "newer" and found["https://a.com/1"]["status_code"] == 404
    assert found["https://a.com/new"]["status_code"] == 200 and found["https://a.com/1"]["key"] == hashlib.md5(b"https://a.com/1").hexdigest()


def test_a_rerun_and_an_older_crawl_change_nothing(spark, make):
    cache = make()
    rows = pages(spark, ROWS)
    assert cache.write(rows)
    before = files(cache)
    assert cache.write(rows) == [] and cache.write(rows.withColumn("last_crawled", F.lit(datetime(2023, 1, 1))).withColumn("html", F.lit("old"))) == []
    assert files(cache) == before


def test_only_touched_buckets_are_rewritten(spark, make):
    cache = make()
    cache.write(pages(spark, ROWS))
    before = files(cache)
    touched = cache.write(pages(spark, [("https://a.com/3", "changed", 200, 9)]))
    assert len(touched) == 1
    after = files(cache)
    assert {d for d, _, _ in before ^ after} == {os.path.join(cache.path, f"bucket={touched[0]}")}


def test_reads_by_address_need_no_exchange(spark, make):
    cache, other = make(), make(folder="other")
    cache.write(pages(spark, ROWS))
    other.write(pages(spark, ROWS[:7]))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = cache.table().select("url", "html").join(other.table().select("url", "last_crawled"), "url")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 7
        wanted = cache.read(pages(spark, ROWS[:3] + [("https://b.com/", "", 200, 1)]))
        assert wanted.count() == 3
        counted = cache.table().groupBy("url").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_stale_pages_go(spark, make):
    cache = make(buckets=64)
    cache.write(pages(spark, ROWS[:5]))
    sources = spark.createDataFrame([("https://a.com/0", datetime(2024, 2, 1)), ("https://a.com/1", datetime(2023, 1, 1)), ("https://a.com/1", None), ("https://a.com/2", None), ("https://x.com/", datetime(2025, 1, 1))], "url string, last_modified timestamp")
    assert [r[0] for r in cache.stale(sources).collect()] == ["https://a.com/0"]
    touched = cache.refresh(pages(spark, [("https://a.com/9", "n", 200, 3)]), sources)
    assert sorted(stored(cache)) == [f"https://a.com/{k}" for k in (1, 2, 3, 4, 9)] and len(touched) == 2
    assert cache.invalidate(pages(spark, [("https://none.com/", "", 200, 1)])) == []


def test_a_new_session_name_finds_the_files(spark, make):
    cache = make()
    cache.write(pages(spark, ROWS))
    assert stored(make(name=f"again_{uuid.uuid4().hex}")) == stored(cache)


def test_an_empty_cache_and_addresses_that_are_none(spark, make):
    cache = make()
    assert cache.read().count() == 0 and cache.write(pages(spark, [])) == [] and cache.invalidate(pages(spark, ROWS)) == []
    cache.write(pages(spark, [("not an address", "x", 200, 1), ("", "y", 200, 1)]))
    assert cache.read().count() == 0 and cache.table().count() == 2

"""Streaming discovery: batches together give the rows of the table, also after a stop; late and repeated pages."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webloom.operators import links
from webloom.streaming import discovery

KIND = "url string, html string, fetched_at timestamp"
START = datetime(2024, 1, 1)


def page(k, hours, *targets):
    return (f"https://a.com/{k}", "".join(f'<a href="{t}">x</a>' for t in targets), START + timedelta(hours=hours))


BATCHES = [
    [page(1, 0, "/x", "/known", "/x?q=1", "https://b.org/out"), page(2, 1, "/x#f", "/y")],
    [page(1, 2, "/x", "/new"), page(3, 3, "/y", "mail:x", "#top")],
    [page(4, 4, "/x")],
]


@pytest.fixture
def stream(spark, tmp_path):
    def write(batch):
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))

    def read():
        return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))

    return write, read


def counts(df):
    return {r["url"]: r["pages"] for r in df.collect()}


def test_batches_give_the_rows_of_the_table(spark, tmp_path, stream):
    write, read = stream
    sitemap = spark.createDataFrame([("https://a.com/known",)], "url string")
    out = str(tmp_path / "out")
    for batch in BATCHES:  # each run goes on from the checkpoint of the one before
        write(batch)
        query = discovery.follow(read(), sitemap, out)
        query.awaitTermination(120)
        assert query.exception() is None
    whole = spark.createDataFrame([row for batch in BATCHES for row in batch], KIND)
    want = counts(links.discovered(links.internal(links.explode_links(whole)), sitemap))
    assert counts(discovery.discovered(discovery.stored_links(spark, out))) == want == {"https://a.com/x": 3, "https://a.com/y": 2, "https://a.com/new": 1}
    assert discovery.stored_links(spark, out).count() == 6  # the link of page 1 to /x, seen in two batches, came out once
    assert counts(discovery.discovered(discovery.new_links(whole, sitemap))) == want
    again = discovery.follow(read(), sitemap, out)
    again.awaitTermination(120)
    assert discovery.stored_links(spark, out).count() == 6


def test_pages_later_than_the_watermark_are_dropped(spark, tmp_path, stream):
    write, read = stream
    sitemap = spark.createDataFrame([], "url string")
    out = str(tmp_path / "out")
    for batch in ([page(1, 100, "/a")], [page(2, 101, "/b")], [page(3, 1, "/late"), page(4, 101, "/c")]):
        write(batch)
        discovery.follow(read(), sitemap, out, late="1 hour").awaitTermination(120)
    assert set(counts(discovery.discovered(discovery.stored_links(spark, out)))) == {"https://a.com/a", "https://a.com/b", "https://a.com/c"}

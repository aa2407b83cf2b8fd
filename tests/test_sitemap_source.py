"""The sitemap source: indexes of indexes, circles, packed parts, pushed filters, faults."""

import gzip

import pytest

from webloom.sources.sitemap_source import NAME, SitemapReader, register, sitemap_tree

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def urlset(*entries):
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"'
    return f"{HEAD}<urlset {space}>" + "".join(f"<url>{e}</url>" for e in entries) + "</urlset>"


def index(*places):
    return f"{HEAD}<sitemapindex>" + "".join(f"<sitemap><loc>{p}</loc><lastmod>2024-01-0{k + 1}</lastmod></sitemap>" for k, p in enumerate(places)) + "</sitemapindex>"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a.com").mkdir()
    site = tmp_path / "a.com"
    (site / "index.xml").write_text(index("https://a.com/inner.xml", "https://a.com/one.xml.gz", "https://a.com/index.xml"))
    (site / "inner.xml").write_text(index("https://a.com/two.xml", "https://a.com/one.xml.gz", "https://a.com/index.xml"))
    one = urlset("<loc>https://a.com/x?a=1&amp;b=2</loc><lastmod>2024-05-01</lastmod><priority>0.5</priority>", "<loc> https://a.com/de/y </loc>", "<lastmod>2024-01-01</lastmod>", "<loc></loc>")
    (site / "one.xml.gz").write_bytes(gzip.compress(one.encode()))
    two = urlset(
        "<loc>https://a.com/en/z</loc><changefreq>daily</changefreq><priority>high</priority>",
        "<loc>https://a.com/fr</loc><image:image><image:loc>https://a.com/i.png</image:loc><image:title>i</image:title></image:image>",
        "<loc>https://a.com/n</loc><news:news><news:publication><news:name>P</news:name></news:publication><news:title>T</news:title></news:news>",
    )
    (site / "two.xml").write_text(two)
    return str(tmp_path)


def test_one_call_reads_an_index_of_indexes_once_each(spark, tree):
    found = sitemap_tree(spark, f"{tree}/a.com/index.xml", all_languages=True, root=tree).collect()
    assert [r["url"] for r in found] == ["https://a.com/en/z", "https://a.com/fr", "https://a.com/n", "https://a.com/x?a=1&b=2", "https://a.com/de/y"]
    by = {r["url"]: r for r in found}
    assert by["https://a.com/en/z"]["priority"] is None and by["https://a.com/x?a=1&b=2"]["priority"] == 0.5
    assert by["https://a.com/fr"]["images"][0].asDict() == {"loc": "https://a.com/i.png", "caption": None, "title": "i"}
    assert by["https://a.com/n"]["news"][0]["publication"] == "P"
    assert by["https://a.com/de/y"]["sitemap"] == "https://a.com/one.xml.gz"


def test_languages_and_limit(spark, tree):
    path = f"{tree}/a.com/index.xml"
    assert [r["url"] for r in sitemap_tree(spark, path, limit=3).collect()] == ["https://a.com/en/z", "https://a.com/n", "https://a.com/x?a=1&b=2"]
    assert sitemap_tree(spark, path).count() == 3


def test_what_is_read_by_options_and_by_filters(spark, tree):
    register(spark)
    read = lambda **o: [r["url"] for r in spark.read.format(NAME).options(**o).load(f"{tree}/a.com/index.xml").collect()]
    assert read(modifiedSince="2024-02-01", prefix="https://a.com/") == ["https://a.com/x?a=1&b=2"]
    assert read(languages="de, fr") == ["https://a.com/fr", "https://a.com/de/y"]
    assert read(modifiedBefore="2024-02-01") == read(modifiedSince="2025") == read(prefix="http:") == []
    rows = spark.read.format(NAME).load(f"{tree}/a.com/index.xml")
    assert rows.filter("lastmod >= '2024-02-01'").count() == 1 and rows.count() == 5  # the same table twice
    assert [r["url"] for r in rows.filter("language = 'de' OR priority = 0.5").orderBy("url").collect()] == ["https://a.com/de/y", "https://a.com/x?a=1&b=2"]


def test_planning_puts_files_into_partitions_by_size(tree):
    plan = SitemapReader({"path": f"{tree}/a.com/index.xml", "partitionbytes": "1"}).partitions()
    assert [[(f.number, f.url.rsplit("/", 1)[-1], f.lastmod) for f in p.files] for p in plan] == [[(0, "two.xml", "2024-01-01")], [(1, "one.xml.gz", "2024-01-02")]]
    assert len(SitemapReader({"path": f"{tree}/a.com/index.xml"}).partitions()) == 1
    folder = SitemapReader({"path": f"{tree}/a.com"}).partitions()
    assert sorted(f.path.rsplit("/", 1)[-1] for p in folder for f in p.files) == ["one.xml.gz", "two.xml"]


def test_missing_and_malformed_files(spark, tmp_path):
    (tmp_path / "index.xml").write_text(index("https://b.com/gone.xml", "https://b.com/bad.xml"))
    (tmp_path / "bad.xml").write_text(urlset("<loc>https://b.com/1</loc>").replace("</urlset>", "<url><loc>https://b.com/2</loc>"))
    path = str(tmp_path / "index.xml")
    with pytest.raises(Exception, match="no sitemap at"):
        sitemap_tree(spark, path).collect()
    with pytest.raises(Exception, match="is no sitemap"):
        sitemap_tree(spark, path, missing="skip").collect()
    assert [r["url"] for r in sitemap_tree(spark, path, missing="skip", malformed="skip").collect()] == ["https://b.com/1"]
    with pytest.raises(Exception, match="'error' or 'skip'"):
        sitemap_tree(spark, path, missing="maybe").collect()
    (tmp_path / "empty.xml").write_text(urlset())
    assert sitemap_tree(spark, str(tmp_path / "empty.xml")).count() == 0

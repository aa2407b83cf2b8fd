"""Operators that need their own inputs: the structural pass, files, history, sinks, streams."""

import json

import pytest
from pyspark.sql import functions as F

from webloom import schemas
from webloom.operators import extract, flow, history, links, llms_txt, robots, technology
from webloom.sinks import reports
from webloom.sources import tables
from webloom.streaming import fetch_log

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><meta name="description" content="d"><meta name="viewport" content="w"><meta name="robots" content="noindex">
<meta property="og:title" content="o"><link rel="canonical" href="https://a.com/p"><link rel="stylesheet" href="/s.css"><link rel="alternate" hreflang="x-default" href="/x"><script src="https://cdn/jquery.js"></script>
<script type="application/ld+json">{"@context":"https://schema.org","@type":["Shop","Thing"]}</script></head><body><h2>early</h2><header>h</header><nav><a href="/in">in</a><a href="https://b.org/" rel="nofollow">out</a><a href="/llms.txt"></a></nav>
<main><h1>Big</h1><img src="a.png" alt=""><img src="b.png"><img src="c.png" alt="c" style="display: none"><table><caption>c</caption><tr><th scope="col">x<td data-price="1">1<td data-v="2">2</table>
<form><label for="e">E</label><input id="e" name="email" type="email" autocomplete="email" required><input name="odd"><button disabled title="why">b</button></form><div role="alert" aria-live="polite" data-state="x" data-agent-visible="true">!</div></main></body></html>"""


def test_structure(spark):
    page = spark.createDataFrame([("https://a.com/p", PAGE), ("https://a.com/e", ""), ("https://a.com/n", None), ("https://a.com/b", "<p><b>unclosed <p>more <script>var t='</p>'")], "url string, html string")
    got = {r["url"]: r for r in extract.page_features(page, base="https://a.com/").collect()}
    r = got["https://a.com/p"]
    assert (r["title"], r["meta_description"], r["h1"], r["html_lang"], r["canonical"], r["has_viewport"]) == ("T & U", "d", "Big", "en", "https://a.com/p", True)
    assert (r["n_internal"], r["n_external"], r["n_nofollow"], r["n_empty_anchor"], len(r["images"]), r["n_images_no_alt_attr"], r["n_images_empty_alt"]) == (2, 1, 1, 1, 3, 1, 1)
    assert (r["n_inputs"], r["n_standard_names"], r["name_ratio"], r["label_ratio"], r["autocomplete_ratio"], r["n_required"]) == (2, 1, 0.5, 0.5, 0.5, 1)
    assert (r["schema_types"], r["has_schema_org"], r["has_llms_txt"], r["has_restrictions"], r["h2_before_h1"], r["hidden_elements"]) == (["Shop", "Thing"], True, True, True, True, 1)
    assert (r["n_tables"], r["tables_with_caption"], r["tables_with_scope"], r["machine_readable_ratio"], r["n_disabled"], r["explained_ratio"]) == (1, 1, 1, 0.5, 1, 1.0)
    assert r["has_persistent_errors"] and r["has_state"] and r["n_agent_visible"] == 1 and r["og"] == {"og:title": "o"}
    assert {(x["type"], x["url"]) for x in r["resources"]} >= {("css", "https://a.com/s.css"), ("javascript", "https://cdn/jquery.js"), ("image", "https://a.com/a.png")}
    assert got["https://a.com/e"]["total_elements"] == got["https://a.com/n"]["total_elements"] == 0 and got["https://a.com/n"]["word_count"] == 1
    assert got["https://a.com/b"]["tag_counts"]["p"] == 2
    found = technology.detect(spark.createDataFrame([(x["url"], x["type"]) for x in r["resources"]], "url string, type string")).collect()
    assert [x["name"] for x in found] == ["jQuery"]


def test_sitemaps(spark, tmp_path):
    (tmp_path / "s.xml").write_text(
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"><url><loc> https://a.com/en/1 </loc><priority>0.5</priority><image:image><image:loc>i.png</image:loc></image:image></url>'
        "<url><loc>https://a.com/de/1</loc></url><url><lastmod>x</lastmod></url></urlset>"
    )
    rows = tables.sitemap(spark, str(tmp_path / "s.xml"), base="https://a.com").orderBy(F.desc("priority")).collect()
    assert [(r["url"], r["priority"]) for r in rows] == [("https://a.com/", 1.0), ("https://a.com/robots.txt", 0.9), ("https://a.com/llms.txt", 0.8), ("https://a.com/en/1", 0.5)]
    assert rows[3]["images"][0]["loc"] == "i.png"
    assert tables.sitemap(spark, str(tmp_path / "s.xml"), all_languages=True).count() == 2
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>https://a.com/s.xml</loc></sitemap></sitemapindex>")
    assert [r["url"] for r in tables.sitemap_index(spark, str(tmp_path / "i.xml")).collect()] == ["https://a.com/s.xml"]
    out = spark.createDataFrame([("https://b/", True), ("https://a/", False)], "url string, discovered boolean")
    reports.write_sitemap(out, str(tmp_path / "out"))
    assert [r["url"] for r in tables.sitemap(spark, str(tmp_path / "out"), all_languages=True).orderBy("url").collect()] == ["https://a/", "https://b/"]


def test_robots_and_llms(spark):
    files = spark.createDataFrame([("s", "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /c$\nUser-agent: Bot\nDisallow:"), ("n", None)], "url string, content string")
    rules = robots.parse(files)
    assert rules.count() == 6 and robots.summary(rules).first()["agents"] == 2
    urls = spark.createDataFrame([("https://s/a",), ("https://s/a/b/c",), ("https://s/c",), ("https://s/cc",), ("https://s/",)], "url string")
    got = {r["url"]: r["allowed"] for r in robots.allowed(urls, rules.filter("url = 's'").drop("url")).collect()}
    assert got == {"https://s/a": False, "https://s/a/b/c": True, "https://s/c": False, "https://s/cc": True, "https://s/": True}
    assert {r["url"]: r["quality"] for r in robots.quality(files).collect()}["n"] == "Missing"
    parsed = llms_txt.parse(spark.createDataFrame([("x", "# T\nshort\nA line that is long enough.\nContact: a@b\n[l](u)")], "url string, content string")).first()
    assert (parsed["title"], parsed["description"], parsed["contact"], parsed["links"][0]["url"]) == ("T", "A line that is long enough.", "a@b", "u")


def test_links(spark):
    pages = spark.createDataFrame([("https://a.com/x/y", '<a href="z">1</a><a href="../q">2</a><a href="#f">3</a><a href="mailto:a@b">4</a><a href="//c.com/">5</a><a href="z?k#l">6</a>')], "url string, html string")
    found = [r["target_url"] for r in links.explode_links(pages).orderBy("position").collect()]
    assert found == ["https://a.com/x/z", "https://a.com/x/../q", "https://c.com/", "https://a.com/x/z?k#l"]
    assert links.internal(links.explode_links(pages)).count() == 2
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("x", "y")], "source string, target string")
    got = {r["url"]: r["depth"] for r in links.reachable(edges, spark.createDataFrame([("a",)], "url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_history(spark, tmp_path):
    runs = [("r1", "2024-01-01 00:00:00", "m", "load_time", 100.0), ("r2", "2024-01-02 00:00:00", "m", "load_time", 140.0), ("r1", "2024-01-01 00:00:00", "m", "url_count", 0.0), ("r2", "2024-01-02 00:00:00", "m", "url_count", 5.0)]
    rows = spark.createDataFrame(runs, "run_id string, run_ts string, family string, metric string, value double").withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    rows.withColumn("schema_version", F.lit(schemas.SCHEMA_VERSION)).write.json(str(tmp_path / "h"))
    (tmp_path / "h" / "bad.json").write_text("{not json\n" + json.dumps({"run_id": "old", "metric": "m", "value": 1.0, "schema_version": "0.9.0"}))
    stored = tables.history(spark, str(tmp_path / "h"))
    assert stored.count() == 4
    found = {r["metric"]: (r["severity"], r["percent"]) for r in history.regressions(history.compare_previous(stored)).collect()}
    assert found == {"load_time": ("critical", 40.0), "url_count": ("info", 100.0)}
    assert {r["metric"]: r["values"] for r in history.trends(stored).collect()}["load_time"] == [100.0, 140.0]
    assert history.establish_baseline(stored).count() == 2
    with pytest.raises(ValueError):
        history.establish_baseline(stored.limit(0))
    lines = [r[0] for r in reports.regression_report(history.regressions(history.compare_previous(stored))).collect()]
    assert lines[0] == "# Regressions" and lines[2] == "2 found" and any("load_time" in x for x in lines[lines.index("## critical") : lines.index("## warning")]) and lines[-1].startswith("| ") and "url_count" in lines[-1]
    many = spark.range(3000).selectExpr("concat('s', id) site", "'load_time' metric", "1D old", "2D new", "100D percent", "if(id % 2 = 0, 'critical', 'warning') severity")
    reports.write_lines(reports.regression_report(many), str(tmp_path / "lines"))
    assert sum(1 for p in sorted((tmp_path / "lines").glob("part-*")) for x in p.read_text().splitlines() if x.startswith("| s") and "site" not in x) == 3000


def test_thresholds_and_csv(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"performance": {"load_time": {"pass": 1, "warn": 2}}}))
    assert tables.thresholds(spark, str(tmp_path / "t.json")).filter("metric = 'load_time'").first()["pass"] == 1.0
    (tmp_path / "w.json").write_text(json.dumps({"seo": {"min_score": {"pass": 1, "warn": 2}}}))
    with pytest.raises(ValueError):
        tables.thresholds(spark, str(tmp_path / "w.json"))
    reports.write_report("missing_sitemap_urls", spark.createDataFrame([('a"b', None)], "url string, pages int"), str(tmp_path))
    assert csv_lines(tmp_path / "missing_sitemap_urls") == [["url,pages", '"a""b",""']]
    assert spark.createDataFrame([("1.2.9", 1), ("1.3.0", 2), (None, 3)], "v string, k int").filter(tables.compatible(F.col("v"), schemas.SCHEMA_VERSION)).count() == 1


def csv_lines(folder):
    """Lines of each part, in the parts' order."""
    return [p.read_text().replace('"url","pages"', "url,pages").splitlines() for p in sorted(folder.glob("part-*.csv"))]


def test_csv_parts(spark, tmp_path):
    """A small table is one file, whatever its partitions, and no part is a header alone; an empty table is a header."""
    rows = spark.range(0, 40, 1, 7).selectExpr("concat('u', id) url", "id pages").filter("pages % 13 = 5")
    reports.write_csv(rows, str(tmp_path / "a"))
    (lines,) = csv_lines(tmp_path / "a")
    assert lines[0] == "url,pages" and sorted(lines[1:]) == ['"u18","18"', '"u31","31"', '"u5","5"']
    reports.write_csv(rows.repartition(5), str(tmp_path / "b"), order=["-pages"])
    assert csv_lines(tmp_path / "b") == [["url,pages", '"u31","31"', '"u18","18"', '"u5","5"']]
    reports.write_csv(rows.limit(0), str(tmp_path / "c"))
    assert csv_lines(tmp_path / "c") in ([["url,pages"]], [])


def test_rate_limiter_stream_and_batch_agree(spark, tmp_path):
    statuses = [200] * 3 + [503, 429, 503, 503, 404] + [200] * 21 + [503]
    rows = [("h", k, s) for k, s in enumerate(statuses)] + [("g", 0, 200)]
    rows += [("start", k, s) for k, s in enumerate([503, 503] + [200] * 20)] + [("none", k, None) for k in range(3)]
    fetches = spark.createDataFrame(rows, "host string, ts int, status int")
    batch = {r["host"]: (r["fetches"], r["concurrency"], r["pause"]) for r in flow.replay(fetches, "host", "ts", "status").collect()}
    # at the initial concurrency successes leave the pause as it is
    assert batch["start"] == (22, 3, 0.5) and batch["none"] == (3, 3, 0.0)
    fetches = fetches.filter("status is not null")
    batch.pop("none")
    fetches.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(fetches.schema).json(str(tmp_path / "in"))
    query = fetch_log.rate_limits(stream).writeStream.outputMode("update").format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["host"]: (r["fetches"], r["concurrency"], r["pause"]) for r in spark.table("limits").collect()}
    assert got == batch


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 200), ("2024-01-01 00:50:00", 500), ("2024-01-01 02:00:00", 200)], "ts string, status int").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = fetch_log.status_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(tuple(r) for r in fetch_log.status_rates(rows).collect())
    assert sorted(tuple(r) for r in spark.table("rates").collect()) == want and want[0][4] == 0.5

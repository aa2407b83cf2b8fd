"""A whole audit over stored pages, its reports, and two runs compared."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tests.test_operators import PAGE
from webloom import config
from webloom.functions import sql
from webloom.plans import audit
from webloom.sinks.reports import REPORTS


def pages(spark):
    rows = [
        ("https://a.com/", PAGE, 200, {"content-security-policy": "x"}),
        ("https://a.com/en/two", "<html><body><main><p>hi <a href='/gone'>g</a></main></body></html>", 200, {}),
        ("https://a.com/de/drei", PAGE, 200, {}),
        ("https://a.com/deep", '<script type="application/ld+json">' + "[" * 100_000 + "</script>", 200, {}),
        ("https://a.com/private/x", PAGE, 200, {}),
        ("https://a.com/gone", "", 404, {}),
        ("https://a.com/robots.txt", "User-agent: *\nDisallow: /private", 200, {}),
        ("https://a.com/llms.txt", "# A\nAll about the site A and its parts.", 200, {}),
    ]
    df = spark.createDataFrame(rows, "url string, html string, status_code int, headers map<string,string>")
    return df.withColumns({"last_modified": F.lit("2024-01-01").cast("timestamp"), "last_crawled": F.lit("2024-01-05").cast("timestamp")})


def test_audit_and_history(spark, tmp_path):
    cfg = config.load(env={}, base_url="https://a.com/", output=str(tmp_path / "out"), history=str(tmp_path / "runs"), as_of="2024-01-05", establish_baseline=True)
    inputs = {
        "sitemap": spark.createDataFrame([("https://a.com/",), ("https://a.com/lonely",)], "url string"),
        "issues": spark.createDataFrame([("https://a.com/", "WCAG2AA.Principle1.Guideline1_1.x", "error", "no alt")], "page_url string, code string, type string, message string"),
        "performance": spark.createDataFrame([("https://a.com/", 900.0)], "url string, load_time double").selectExpr("*", *[f"double(null) {c}" for c in ("dom_content_loaded", "first_paint", "fcp", "lcp", "tti", "tbt", "cls")]),
    }
    found = audit.run(pages(spark), cfg, "r1", datetime.datetime(2024, 1, 5), **inputs)
    assert sorted(r["url"] for r in found["seo_scores"].collect()) == ["https://a.com/", "https://a.com/en/two"]
    assert [r["status_code"] for r in found["http_status_report"].collect()] == [404]
    assert {r["url"]: r["score"] for r in found["accessibility_report"].collect()} == {"https://a.com/": 90, "https://a.com/en/two": 100}
    assert "https://a.com/gone" in {r["url"] for r in found["missing_sitemap_urls"].collect()}
    assert [r["url"] for r in found["orphaned_urls"].collect()] == ["https://a.com/", "https://a.com/lonely"] or {r["url"] for r in found["orphaned_urls"].collect()} >= {"https://a.com/lonely"}
    feedback = {r["url"]: r["feedback"] for r in found["llm_general_suitability"].collect()}
    assert "robots_restrictions" in feedback["https://a.com/"] and "no_nav" in feedback["https://a.com/en/two"]
    assert found["technologies"].first()["names"] == ["jQuery"]
    assert {(r["url"], r["reason"].split(":")[0], r["attempts"]) for r in found["failed_urls"].collect()} == {("https://a.com/gone", "status 404", 1), ("https://a.com/deep", "RecursionError", 1)}
    assert tuple(found["pass_counts"].first()) == (3, 1)
    for name in REPORTS:
        assert list((tmp_path / "out" / name).glob("part-*.csv")), name
    assert found["regressions"].count() == 0
    check_more(found, tmp_path / "out")
    slow = dict(inputs, performance=inputs["performance"].withColumn("load_time", F.lit(9000.0)))
    again = audit.run(pages(spark), cfg, "r2", datetime.datetime(2024, 1, 6), **slow)
    assert ("load_time", "critical") in {(r["metric"], r["severity"]) for r in again["regressions"].collect()}


def text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def check_more(found, out):
    """Site-wide files, summaries, advice, older reports and chart data of the first run."""
    two = {r["url"]: r for r in found["llm_backend_suitability"].collect()}["https://a.com/en/two"]
    assert two["has_llms_txt"] and two["backend_score"] == 40  # 30 for its status, 10 for the site's llms.txt
    links = {(r["source_url"], r["target_url"]): r["in_navigation"] for r in found["link_analysis"].collect()}
    assert links["https://a.com/", "https://a.com/in"] is True and links["https://a.com/en/two", "https://a.com/gone"] is False
    one = found["summary_seo"].first()
    assert one["pages"] == 2 and one["status"] in ("Fair", "Needs Improvement", "Good")
    assert found["summary_accessibility"].first()["errors"] == 1 and found["summary_content"].first()["low_content_pages"] == 2
    assert {r["category"] for r in found["findings"].collect()} >= {"Accessibility", "Content", "AI Compatibility"}
    assert "Say more on short pages, or join them; there are 2" in {r["recommendation"] for r in found["recommendations"].collect()}
    sections = {r["item"]: r["value"] for r in found["seo_sections"].collect()}
    assert sections["Total URLs"] == 4 and sections["4xx"] == 1 and sections["Missing titles"] == 1 and sections["Pages with hreflang"] == 1 and sections["Self-referencing canonicals"] == 0
    comments = {r["item"]: (r["value"], r["comment"]) for r in found["seo_sections"].collect()}
    assert sections["Orphaned URLs"] == found["orphaned_urls"].count() and sections["Total issues"] == sections["error issues"] == 1
    assert comments["Average Load Time"] == (900.0, "Excellent") and comments["Average First Paint"] == (None, "N/A") and comments["Lowest SEO Score"][1] == "Poor"
    assert "Give every page a title" in {r["recommendation"] for r in found["seo_advice"].collect()}
    assert [r["manual_check"] for r in found["issues_by_code"].collect()] == ["Read the page without images: is anything lost?"]
    summary = json.loads(text(out / "executive_summary.json"))
    assert summary["seo"][0]["pages"] == 2 and "## findings" in text(out / "executive_summary.md")
    assert "Semantic HTML Structure" in text(out / "pattern_library.md") and "llms.txt" in text(out / "ai_files_summary.md") and "Text Alternatives" in text(out / "accessibility_report.md")
    assert text(out / "regression_report.md").splitlines()[2] == "no baseline is pinned"
    read = lambda name: {r["url"]: r for r in found["seo_scores"].sparkSession.read.option("header", True).option("escape", '"').csv(str(out / name)).collect()}
    general, front, back, readable = (read(n) for n in ("llm_general_suitability", "llm_frontend_suitability", "llm_backend_suitability", "llm_readability_report"))
    two, home = "https://a.com/en/two", "https://a.com/"
    assert general[two]["has_nav"] == "false" and general[two]["top_issue"] == "The page does not mark its menus" and general[two]["site_has_llms_txt"] == "true"
    assert int(general[two]["essential_issues"]) + int(general[two]["other_issues"]) == len(json.loads(general[two]["feedback"])) and general[two]["priority"] == "Critical"
    assert front[two]["recommendations"].count("; ") == 1 and front[home]["forms"] == "1" and front[home]["standard_percent"] == "50" and front[home]["captcha_type"] == "None"
    assert back[two]["status_good"] == "true" and "Schema.org" in back[two]["issues"] and back[home]["json_ld"] == "1" and back[two]["llms_href"] == "N/A"
    assert readable[two]["semantic_usage"] == "Fair" and readable[home]["heading_quality"] == "Excellent" and readable[home]["has_main_content"] == "true" and float(readable[home]["text_percent"]) > 0
    files = {n: next(iter(read(n).values())) for n in ("robots_txt_quality", "llms_txt_quality")}
    assert files["robots_txt_quality"]["exists"] == "true" and files["robots_txt_quality"]["max_score"] == "100" and int(files["robots_txt_quality"]["rules"]) >= 1
    assert files["llms_txt_quality"]["core_total"] == "4" and files["llms_txt_quality"]["sections_total"] == "6" and files["llms_txt_quality"]["length"] == "Insufficient"
    assert {r["label"]: r["value"] for r in found["chart_seo_distribution"].collect()}["<60"] == 2.0
    assert {p.name for p in (out / "charts").iterdir()} == {"performance", "seo_distribution", "content", "agents", "accessibility", "performance_trend", "accessibility_trend"}
    rows = text(out / "seo_sections").splitlines()
    assert rows[1].startswith('"Header","https://a.com/"') and rows[2].startswith('"Summary","Total URLs"') and len(rows) == found["seo_sections"].count() + 1
    assert {r["metric"] for r in found["comparison"].collect()} == set()


def test_runs_of_sites_are_compared_by_site(spark):
    from webloom.operators import history

    rows = [(s, t, "load_time", v) for s, t, v in (("a", 1, 100.0), ("b", 2, 900.0), ("a", 3, 110.0), ("b", 4, 890.0))]
    df = spark.createDataFrame(rows, "site string, run_ts int, metric string, value double")
    assert sorted((r["site"], r["old"], r["new"]) for r in history.compare_previous(df).collect()) == [("a", 100.0, 110.0), ("b", 900.0, 890.0)]
    assert {r["site"]: r["values"] for r in history.trends(df).collect()} == {"a": [100.0, 110.0], "b": [900.0, 890.0]}


def test_tables_written_by_several_threads(spark):
    """Settings while tables are written are those of no other query afterwards, whoever writes."""
    from concurrent.futures import ThreadPoolExecutor

    from webloom import storage

    before = spark.conf.getAll
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda k: storage.materialize(spark.range(k), "t"), range(1, 9)))
    assert [df.count() for df in made] == list(range(1, 9)) and spark.conf.getAll == before
    kept = []
    with storage.scratch(kept):
        kept.append(storage.materialize(spark.range(3), "t"))
        other = storage.materialize(spark.range(4), "t")
    assert kept[0].count() == 3 and other.stored_at not in storage._made
    storage.discard(*made, *kept)


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"limit": 5, "base_url": "https://x.org"}))
    got = config.load(str(tmp_path / "c.json"), {"WEBLOOM_LIMIT": "7", "WEBLOOM_RENDERED": "yes", "OTHER": "x"}, output="o")
    assert (got.limit, got.base_url, got.rendered, got.output) == (7, "https://x.org", True, "o")
    for bad in ({"limit": 0}, {"base_url": "ftp://x"}, {"pattern_score_threshold": 101.0}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            config.load(env={}, **bad)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT wl_ramp(45, 30, 60) a, wl_half_up(-2.5) b, wl_percent_change(4, 3) c, wl_host('HTTP://Ex.com:1/x') d, wl_link_depth('https://a/b/c') e, wl_syllables('hello') f, wl_word_count('') g, wl_title_score('') h").first()
    assert tuple(row) == (0.5, -2, -25.0, "ex.com", 2, 2, 1, 0.0)
    pages(spark).createOrReplaceTempView("stored")
    got = spark.sql("SELECT s.url, t.h1, t.links FROM stored s, LATERAL wl_extract_page(s.html, s.url) t WHERE s.url = 'https://a.com/'").first()
    assert (got["h1"], got["links"]) == ("Big", 3)


def test_page_fields_as_a_table_function(spark):
    sql.register(spark)
    pages(spark).createOrReplaceTempView("stored")
    found = spark.sql("SELECT * FROM wl_page_fields(TABLE(SELECT url, html FROM stored WHERE status_code = 200), 'h1, n_internal, tag_counts')")
    assert found.dtypes == [("url", "string"), ("h1", "string"), ("n_internal", "int"), ("tag_counts", "map<string,int>")]
    rows = {r["url"]: r for r in found.collect()}
    assert rows["https://a.com/"]["h1"] == "Big" and rows["https://a.com/"]["tag_counts"]["h1"] == 1 and rows["https://a.com/en/two"]["n_internal"] == 1
    sites = spark.sql("SELECT url FROM wl_page_fields(TABLE(SELECT url, html, substring(url, 1, 13) AS site FROM stored), 'h1', 'site')")
    assert sites.count() == 8 and "Exchange hashpartitioning(" in sites._jdf.queryExecution().executedPlan().toString()
    for wrong in ("wl_page_fields(TABLE(stored), 'h7')", "wl_page_fields(TABLE(SELECT url FROM stored), 'h1')", "wl_page_fields('x', 'h1')"):
        with pytest.raises(Exception, match="no field|a table with"):
            spark.sql(f"SELECT * FROM {wrong}").collect()

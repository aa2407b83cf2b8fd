"""Expressions against literal vectors."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import accessibility, agents, content, markup, numbers, security, seo, urls
from webloom.sinks.reports import two_decimals


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_numbers(spark):
    assert one(spark, numbers.ramp(F.lit(45), 30, 60), numbers.ramp(F.lit(None).cast("int"), 30, 60), numbers.ramp(F.lit(99), 30, 60)) == (0.5, 0.0, 1.0)
    assert one(spark, numbers.half_up(F.lit(-2.5)), numbers.half_up(F.lit(2.5))) == (-2, 3)
    assert one(spark, numbers.percent_change(F.lit(0.0), F.lit(0.0)), numbers.percent_change(F.lit(0.0), F.lit(3.0)), numbers.percent_change(F.lit(4.0), F.lit(3.0))) == (0.0, 100.0, -25.0)
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0), 1.0), numbers.percentage(F.lit(1), F.lit(3))) == (1.0, 33.33)


@pytest.mark.parametrize(("value", "want"), [(95.1234, "95.12"), (95, "95.00"), (None, "0.00")])
def test_two_decimals(spark, value, want):
    assert one(spark, two_decimals(F.lit(value).cast("double"))) == (want,)


@pytest.mark.parametrize(("word", "n"), [("hello", 2), ("world", 1), ("accessibility", 6)])
def test_syllables(spark, word, n):
    assert one(spark, content.syllables(F.lit(word))) == (n,)


@pytest.mark.parametrize(("src", "want"), [("image.jpg", "jpg"), ("image.png", "png"), ("image.webp", "webp"), ("image.jpg?v=123", "jpg"), ("image.txt", "img unknown"), ("", "unknown")])
def test_image_format(spark, src, want):
    assert one(spark, urls.image_format(F.lit(src))) == (want,)


@pytest.mark.parametrize(("url", "n"), [("https://example.com/a/b/c", 3), ("https://example.com/", 0), ("invalid-url", 0), ("https://example.com", 0)])
def test_link_depth(spark, url, n):
    assert one(spark, urls.link_depth(F.lit(url))) == (n,)


def test_urls(spark):
    u = F.lit("HTTPS://User@Ex.COM:443//a//b/?b=2&a=1#x")
    assert one(spark, urls.host(u), urls.origin(u), urls.path(u), urls.query(u)) == ("ex.com", "https://ex.com", "//a//b/", "b=2&a=1")
    assert one(spark, urls.normalize(u)) == ("https://ex.com/a/b?a=1&b=2",)
    assert one(spark, urls.collapse_slashes(F.lit("http://a//b///c"))) == ("http://a/b/c",)
    valid = [("https://a.com/de/x", False), ("https://a.com/en/x", True), ("https://a.com/x.PDF", False), ("ftp://a.com/", False), ("nonsense", False), ("https://a.com/US", True)]
    for url, want in valid:
        assert one(spark, urls.is_valid(F.lit(url))) == (want,), url
    assert one(spark, urls.link_type(F.lit("https://a/x#y"), F.lit("https://a/")), urls.link_type(F.lit("https://b/"), F.lit("https://a/")), urls.link_type(F.lit("b"), F.lit("https://a/"))) == ("Internal Anchor", "External", "Invalid URL")
    assert one(spark, urls.is_sitemap_xml(F.lit("<?xml?><urlset></urlset>")), urls.is_sitemap_xml(F.lit("<html>"))) == (True, False)


def test_markup(spark):
    html = F.lit("<html lang='de'><title> A\n</title><body><h2>x</h2><h1>B <b>c</b></h1><p>one two</body>")
    m = markup.heading_metrics(html)
    assert one(spark, markup.title(html), markup.html_lang(html), m["h2_before_h1"], m["h1_missing"], markup.count_tag(html, "h1")) == ("A", "de", True, False, 1)
    assert one(spark, markup.word_count(F.lit("")), markup.word_count(F.lit(" a b "))) == (1, 2)
    assert one(spark, markup.missing_heading_levels([F.lit(x) for x in (1, 0, 2, 0, 0, 1)]), markup.missing_heading_levels([F.lit(0)] * 6)) == ("H2, H4, H5", "H1")


def test_security(spark):
    headers = F.create_map(F.lit("x-frame-options"), F.lit(""), F.lit("content-security-policy"), F.lit("script-src 'unsafe-inline'"))
    assert one(spark, security.header_score(headers), security.csp_score(headers), security.xss_score(headers)) == (20.0, 0, 35)
    assert one(spark, security.cookie_score(F.array(F.lit("a=1; Secure; HttpOnly; SameSite=x; Max-Age=1"))), security.cookie_score(F.lit(None).cast("array<string>"))) == (100, 0)
    assert one(spark, security.vulnerabilities(F.lit("<form><form> eval( innerHTML=")), security.mixed_content(F.lit(None).cast("string"))) == (3, 0)


def test_accessibility(spark):
    c = F.lit("WCAG2AA.Principle1.Guideline1_4.x")
    assert one(spark, accessibility.guideline(c), accessibility.level(c), accessibility.severity(F.lit("error"), c), accessibility.guideline(F.lit("x"))) == ("1.4", "AA", "Critical", None)


def test_scores_stay_in_range(spark):
    flags = [F.lit(True)] * 30
    names = "has_main has_nav has_header has_footer has_article has_section has_schema_org has_llms_txt has_ai_txt has_restrictions has_state has_validation has_loading has_persistent_errors has_invalid".split()
    m = dict(zip(names, flags, strict=False)) | {"n_tables": F.lit(0), "tables_with_scope": F.lit(0), "tables_with_caption": F.lit(0), "name_ratio": F.lit(1.0), "label_ratio": F.lit(1.0), "autocomplete_ratio": F.lit(1.0)}
    served, rendered = one(spark, agents.served_score(m), agents.rendered_score(agents.served_score(m), m))
    assert served == 95.0 and rendered == 100.0
    assert one(spark, seo.overall({k: F.lit(1.0) for k in seo.WEIGHTS}), seo.overall({})) == (100, 0)


def test_freshness(spark):
    at = F.lit("2024-03-01").cast("timestamp")
    assert one(spark, content.freshness_status(F.lit("2024-02-25").cast("timestamp"), at, at), content.freshness_status(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"), at)) == ("Very Fresh", "Unknown")
    assert one(spark, content.freshness_score(F.lit("2023-01-01").cast("timestamp"), at))[0] == pytest.approx(30 - (425 - 365) / 100)

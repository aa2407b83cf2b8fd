"""Schemas of the audit tables, in Spark's data definition language."""

from __future__ import annotations

PAGES = "run_id string, url string, html string, status_code int, headers map<string,string>, js_errors array<string>, last_modified timestamp, last_crawled timestamp"
SITEMAP_URLS = (
    "url string, lastmod string, changefreq string, priority double, images array<struct<loc:string,caption:string,title:string>>, news array<struct<publication:string,publication_date:string,title:string>>"
)
LINKS = "source_url string, position int, target_url string, text string, rel string, title string"
RESOURCES = "page_url string, url string, type string"
A11Y_ISSUES = "page_url string, code string, type string, message string, context string, selector string"
PERFORMANCE = "url string, load_time double, dom_content_loaded double, first_paint double, fcp double, lcp double, tti double, tbt double, cls double"
RUN_METRICS = "run_id string, run_ts timestamp, site string, family string, metric string, value double"
THRESHOLDS = "category string, metric string, higher_is_better boolean, pass double, warn double"

#: Version written with each stored run; runs with the same major and minor number can be read.
SCHEMA_VERSION = "1.2.0"

"""Technologies behind a site, by substrings of resource addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.automata import substrings
from webloom.session import ship

#: Name, category, confidence, whether only scripts count, whether case counts, and the substrings.
RULES = [
    ("Adobe Experience Manager Edge Delivery Services", "CMS", "high", True, False, ("aem.js", ".hlx.page", ".hlx.live")),
    ("Adobe Experience Manager Edge Delivery Services", "CMS", "medium", True, False, ("franklin", "/clientlibs/", "/libs/granite/", "/libs/cq/")),
    ("React", "Framework", "high", True, True, ("react", "React")),
    ("Vue.js", "Framework", "high", True, True, ("vue", "Vue")),
    ("Angular", "Framework", "high", True, True, ("angular", "Angular")),
    ("Svelte", "Framework", "high", True, True, ("svelte",)),
    ("Next.js", "Framework", "high", True, True, ("next", "_next/")),
    ("Nuxt.js", "Framework", "high", True, True, ("nuxt", "_nuxt/")),
    ("jQuery", "Library", "high", True, True, ("jquery",)),
    ("Lodash", "Library", "high", True, True, ("lodash",)),
    ("Moment.js", "Library", "high", True, True, ("moment",)),
    ("Three.js", "Library", "high", True, True, ("three",)),
    ("D3.js", "Library", "high", True, True, ("d3.", "d3.min")),
    ("Chart.js", "Library", "high", True, True, ("chart.js", "chartjs")),
    ("GSAP", "Library", "high", True, True, ("gsap",)),
    ("Alpine.js", "Library", "high", True, True, ("alpine",)),
    ("HTMX", "Library", "high", True, True, ("htmx",)),
    ("WordPress", "CMS", "high", True, True, ("wp-includes", "wp-content")),
    ("WordPress", "CMS", "high", False, True, ("wp-admin",)),
    ("Drupal", "CMS", "high", True, True, ("/drupal", "drupal.js")),
    ("Joomla", "CMS", "high", True, True, ("joomla", "/components/com_")),
    ("Shopify", "CMS", "high", True, True, ("shopify", "cdn.shopify.com")),
    ("Wix", "CMS", "high", True, True, ("wix.com", "wixstatic.com")),
    ("Squarespace", "CMS", "high", True, True, ("squarespace",)),
    ("Webflow", "CMS", "high", True, True, ("webflow",)),
    ("Google Analytics", "Analytics", "high", True, True, ("google-analytics.com", "googletagmanager.com", "/gtag/")),
    ("Adobe Analytics", "Analytics", "high", True, True, ("omniture", "2o7.net")),
    ("Matomo", "Analytics", "high", True, True, ("matomo", "piwik")),
    ("Hotjar", "Analytics", "high", True, True, ("hotjar",)),
    ("Mixpanel", "Analytics", "high", True, True, ("mixpanel",)),
    ("Segment", "Analytics", "high", True, True, ("segment",)),
    ("Cloudflare CDN", "CDN", "high", False, True, ("cloudflare", "cdnjs.cloudflare.com")),
    ("Akamai", "CDN", "high", False, True, ("akamai",)),
    ("Fastly", "CDN", "high", False, True, ("fastly",)),
    ("CloudFront", "CDN", "high", False, True, ("cloudfront",)),
]


def _numbered(found: Column, numbers: list[int]) -> Column:
    """``numbers`` at the places that an array names."""
    every = F.array(*[F.lit(k) for k in numbers])
    return F.transform(found, lambda i: every[i])


def detect(resources: DataFrame, by: list[str] | None = None, rules: list[tuple] | None = None) -> DataFrame:
    """(by…, category, name, confidence) of all technologies seen, by RULES or a list like it of any length. Each distinct address, which most pages share with others, is scanned once by
    one automaton over all substrings (and, in lower case, by one over those that ignore case); what is found is joined back to the resources."""
    by, rules = by or [], RULES if rules is None else rules
    words = {case: [(k, w) for k, r in enumerate(rules) for w in r[5] if r[4] == case] for case in (True, False)}
    rows = resources.select(*by, "url", F.coalesce("type", F.lit("")).alias("type"))
    ship(resources.sparkSession)
    found, hits = rows.select("url", "type").distinct(), []
    for case, text in ((True, F.col("url")), (False, F.lower("url"))):
        if words[case]:
            found = found.withColumn(f"_{case}", substrings(text, [w for _, w in words[case]]))
            hits.append(_numbered(F.col(f"_{case}"), [k for k, _ in words[case]]))
    if not hits:
        hits = [F.array().cast("array<int>")]
    known = resources.sparkSession.createDataFrame([(k, r[0], r[1], r[2], r[3]) for k, r in enumerate(rules)], "_rule int, name string, category string, confidence string, _scripts boolean")
    found = found.select("url", "type", F.explode(F.array_distinct(F.concat(*hits))).alias("_rule")).join(known, "_rule").filter(~F.col("_scripts") | (F.col("type") == "javascript"))
    found = found.select("url", "type", "category", "name", "confidence")
    rows = rows.join(found, ["url", "type"]) if by else found
    return rows.groupBy(*by, "category", "name").agg(F.min("confidence").alias("confidence"))


def by_category(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    return found.groupBy(*(by or []), "category").agg(F.array_sort(F.collect_set("name")).alias("names"))

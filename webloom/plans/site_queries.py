"""Queries over whole sites: issues, resources, technologies, robots and llms files, patterns, performance, streams on batch input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import flow, llms_txt, patterns, robots, rollups, technology
from webloom.plans.page_queries import SQL_FIRST, long, six
from webloom.plans.registry import register
from webloom.plans.score_queries import SQL_PAGES, _pages, sql_points
from webloom.sources import tables
from webloom.sources.tables import table
from webloom.streaming import fetch_log

#: Issue codes, types and messages that an event stands for.
CODES = ["WCAG2AA.Principle1.Guideline1_1.1_1_1.H37", "WCAG2AA.Principle1.Guideline1_4.1_4_3.G18.Fail", "WCAG2A.Principle2.Guideline2_1.2_1_1", "WCAG2AAA.Principle3.Guideline3_1.3_1_1", "ARIA.4_1_2", "WCAG2AA.Principle1.Guideline1_4.1_4_3.Contrast", "custom.KeyboardTrap"]
TYPES = ["error", "warning", "notice"]


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k,
        F.col("user_id").alias("page_url"),
        F.array(*[F.lit(c) for c in CODES])[(k % len(CODES)).cast("int")].alias("code"),
        F.array(*[F.lit(t) for t in TYPES])[(k % 3).cast("int")].alias("type"),
        F.when(k % 11 != 0, F.concat(F.lit("Contrast and ARIA "), F.col("event_type"), F.when(k % 4 == 0, " keyboard").otherwise(""))).alias("message"),
    )


SQL_ISSUES = (
    "i AS (SELECT event_id, user_id AS page_url, [" + ", ".join(f"'{c}'" for c in CODES) + f"][(event_id % {len(CODES)} + 1)::INT] AS code, [" + ", ".join(f"'{t}'" for t in TYPES) + "][(event_id % 3 + 1)::INT] AS type, CASE WHEN event_id % 11 <> 0 THEN 'Contrast and ARIA ' || event_type || CASE WHEN event_id % 4 = 0 THEN ' keyboard' ELSE '' END END AS message FROM events), "
    "v AS (SELECT *, CASE WHEN type = 'error' AND code LIKE 'WCAG2AA%' THEN 'Critical' WHEN type = 'error' AND code LIKE 'WCAG2A%' THEN 'Serious' WHEN type = 'warning' AND code LIKE 'WCAG2%' THEN 'Moderate' ELSE 'Minor' END AS severity, regexp_extract(code, 'WCAG2(A{1,3})', 1) AS level, regexp_extract(code, 'Guideline(\\d+)_(\\d+)', 1) || '.' || regexp_extract(code, 'Guideline(\\d+)_(\\d+)', 2) AS guideline FROM i)"
)


@register(f"""WITH {SQL_ISSUES} SELECT page_url, count(*) AS issues, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Serious') AS serious, count(*) FILTER (severity = 'Moderate') AS moderate, count(*) FILTER (severity = 'Minor') AS minor,
 count(*) FILTER (level = 'A') AS level_a, count(*) FILTER (level = 'AA') AS level_aa, count(*) FILTER (level = 'AAA') AS level_aaa, count(*) FILTER (contains(code, 'ARIA')) AS aria, count(*) FILTER (contains(code, 'Contrast')) AS contrast, count(*) FILTER (contains(lower(code), 'keyboard')) AS keyboard,
 greatest(0, 100 - 2 * sum(CASE severity WHEN 'Critical' THEN 5 WHEN 'Serious' THEN 3 WHEN 'Moderate' THEN 2 ELSE 1 END))::BIGINT AS score FROM v GROUP BY 1""")
def accessibility_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.issue_analysis(_issues(spark, sf_dir)).drop("manual_checks").withColumn("score", long(F.col("score")))


@register(f"WITH {SQL_ISSUES} SELECT code, message, count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) > 40")
def common_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.common_issues(_issues(spark, sf_dir), more_than=40)


@register(f"WITH {SQL_ISSUES}, c AS (SELECT code, message FROM i GROUP BY 1, 2 HAVING count(*) > 100) SELECT i.event_id FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.code = i.code AND c.message IS NOT DISTINCT FROM i.message)")
def issues_not_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir)
    return rollups.unrepeated(issues, rollups.common_issues(issues, more_than=100)).select("event_id")


@register(f"""WITH {SQL_ISSUES} SELECT page_url, code, count(*) AS n, min(type) AS type, min(message) AS message, arg_min(severity, list_position(['Critical', 'Serious', 'Moderate', 'Minor'], severity)) AS severity, nullif(min(level), '') AS level, CASE WHEN min(guideline) = '.' THEN NULL ELSE min(guideline) END AS guideline,
 CASE min(guideline) WHEN '1.1' THEN 'Read the page without images: is anything lost?' WHEN '1.4' THEN 'Measure contrasts, and enlarge the text to twice its size' WHEN '2.1' THEN 'Use everything without a mouse' WHEN '3.1' THEN 'Look whether the language of page and quotations is marked' END AS manual_check FROM v GROUP BY 1, 2""")
def issues_by_page_and_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.issues_by_page_and_code(_issues(spark, sf_dir)).drop("guideline_name", "remediation")


@register(f"""WITH {SQL_ISSUES}, g AS (SELECT unnest(['1.1','1.2','1.3','1.4','2.1','2.2','2.3','2.4','2.5','3.1','3.2','3.3','4.1']) AS guideline), n AS (SELECT guideline, count(*) AS n FROM v GROUP BY 1)
SELECT g.guideline, coalesce(n, 0) AS issues, coalesce(n, 0) = 0 AS compliant FROM g LEFT JOIN n USING (guideline)""")
def guideline_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.guideline_compliance(_issues(spark, sf_dir)).drop("name", "manual_check")


@register(f"""WITH {SQL_ISSUES}, s AS (SELECT count(*) AS issues, count(*) FILTER (type = 'error') AS errors, count(*) FILTER (type = 'warning') AS warnings, count(*) FILTER (type = 'notice') AS notices, count(DISTINCT page_url) AS pages FROM i), g AS (SELECT *, greatest(0.0, 100 - 5 * errors - 2 * warnings - 0.5 * notices)::DOUBLE AS score FROM s)
SELECT issues, errors, warnings, notices, floor(score + 0.5)::BIGINT AS score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair' ELSE 'Critical' END AS label, round(issues::DOUBLE / pages, 1) AS per_page FROM g""")
def accessibility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as issues, over the pages that they name; so many issues take the score to its floor."""
    return rollups.accessibility_summary(_issues(spark, sf_dir))


@register(f"""WITH {SQL_ISSUES}, s AS (SELECT user_id, count(*) FILTER (type = 'error') AS errors, count(*) FILTER (type = 'warning') AS warnings, count(*) FILTER (type = 'notice') AS notices, count(*) AS n FROM (SELECT page_url AS user_id, type FROM i) GROUP BY 1), g AS (SELECT *, greatest(0.0, 100 - 5 * errors - 2 * warnings - 0.5 * notices)::DOUBLE AS score FROM s)
SELECT user_id, score FROM g""")
def accessibility_site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a site with its events as issues, so that scores come from all parts of the scale."""
    from webloom.functions import accessibility

    counts = _issues(spark, sf_dir).groupBy(F.col("page_url").alias("user_id")).agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES])
    return counts.select("user_id", accessibility.site_score(*[F.col(t) for t in TYPES]).alias("score"))


@register(f"""WITH {SQL_ISSUES}, a AS (SELECT page_url, count(*) AS n FROM i WHERE type = 'error' GROUP BY 1) SELECT c_custkey AS url, coalesce(n, 0) AS errors, CASE WHEN n IS NULL THEN 100 ELSE greatest(0, 100 - n) END AS score FROM customer LEFT JOIN a ON c_custkey = page_url""")
def pages_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages, left-joined with their aggregated issues; a page without any has the full score."""
    errors = _issues(spark, sf_dir).filter("type = 'error'").groupBy(F.col("page_url").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"))
    return pages.join(errors, "url", "left").select("url", F.coalesce("n", F.lit(0)).alias("errors"), F.when(F.col("n").isNull(), 100).otherwise(F.greatest(F.lit(0), 100 - F.col("n"))).alias("score"))


SCRIPTS = ["https://cdn.x/react.min.js", "https://y/jquery-3.js", "https://z/wp-content/a.js", "https://www.google-analytics.com/ga.js", "https://cdnjs.cloudflare.com/d3.min.js", "https://q/main.css", "https://w/aem.js", "https://s.akamai.net/x.png"]


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("l_partkey") % len(SCRIPTS)).cast("int")
    url = F.array(*[F.lit(s) for s in SCRIPTS])[k]
    kind = F.when(F.endswith(url, F.lit(".js")), "javascript").when(F.endswith(url, F.lit(".css")), "css").otherwise("image")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_url"), F.concat(url, F.lit("?v="), F.col("l_linenumber")).alias("url"), kind.alias("type"))


SQL_RESOURCES = "r AS (SELECT l_orderkey AS page_url, u || '?v=' || l_linenumber AS url, CASE WHEN u LIKE '%.js' THEN 'javascript' WHEN u LIKE '%.css' THEN 'css' ELSE 'image' END AS type FROM (SELECT *, [" + ", ".join(f"'{s}'" for s in SCRIPTS) + f"][(l_partkey % {len(SCRIPTS)} + 1)::INT] AS u FROM lineitem))"


@register(f"WITH {SQL_RESOURCES} SELECT url, min(type) AS type, count(*) AS uses, count(DISTINCT page_url) AS pages FROM r GROUP BY url")
def resource_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.resource_totals(_resources(spark, sf_dir))


@register(f"WITH {SQL_RESOURCES}, t AS (SELECT url, min(type) AS type, count(*) AS uses FROM r GROUP BY url) SELECT type, count(*) AS unique_resources, sum(uses)::BIGINT AS total_uses FROM t GROUP BY type")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.resource_summary(rollups.resource_totals(_resources(spark, sf_dir)))


@register(f"WITH {SQL_RESOURCES} SELECT url, count(*) AS uses FROM r GROUP BY url ORDER BY uses DESC, url LIMIT 10")
def top_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the ten most used resources."""
    return rollups.resource_totals(_resources(spark, sf_dir)).select("url", "uses").orderBy(F.desc("uses"), "url").limit(10)


SQL_TECH = [("Framework", "React", "contains(url, 'react') AND type = 'javascript'"), ("Library", "jQuery", "contains(url, 'jquery') AND type = 'javascript'"), ("CMS", "WordPress", "contains(url, 'wp-content') AND type = 'javascript'"), ("Analytics", "Google Analytics", "contains(url, 'google-analytics.com') AND type = 'javascript'"), ("Library", "D3.js", "contains(url, 'd3.') AND type = 'javascript'"), ("CDN", "Cloudflare CDN", "contains(url, 'cloudflare')"), ("CDN", "Akamai", "contains(url, 'akamai')"), ("CMS", "Adobe Experience Manager Edge Delivery Services", "contains(url, 'aem.js') AND type = 'javascript'")]


@register(f"WITH {SQL_RESOURCES}, t AS (" + " UNION ".join(f"SELECT page_url, '{c}' AS category, '{n}' AS name FROM r WHERE {w}" for c, n, w in SQL_TECH) + ") SELECT page_url, category, string_agg(name, ',' ORDER BY name) AS names FROM t GROUP BY 1, 2")
def technology_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = technology.by_category(technology.detect(_resources(spark, sf_dir), ["page_url"]), ["page_url"])
    return found.select("page_url", "category", F.array_join("names", ",").alias("names"))


def _lines(lines: list[tuple[str, str]]) -> str:
    """An expression, for both engines, of a text made of those lines whose condition on k holds; null and empty for some k."""
    parts = ", ".join(f"CASE WHEN {when} THEN {text} END" for text, when in lines)
    return f"CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN '' ELSE concat_ws(chr(10), {parts}) END"


ROBOTS = _lines(
    [
        ("'# see LLMS.txt'", "k % 2 = 0"), ("'#note'", "k % 3 = 0"), ("'# more: x'", "k % 5 = 0"), ("'Disallow: /'", "k % 4 = 0"), ("'User-agent: GPTBot'", "k % 2 = 1"), ("'Disallow: /Admin/x'", "k % 4 < 2"),
        ("'  User-agent: ClaudeBot '", "k % 7 = 0"), ("'Disallow: /cart # c'", "k % 3 = 1"), ("'Allow: /en/'", "k % 2 = 0"), ("'USER-AGENT: cohere-ai'", "k % 5 < 2"), ("'User-agent: GPTBot'", "k % 6 = 0"),
        ("'disallow:/user/' || k", "k % 6 < 2"), ("'Disallow: /cart # c'", "k % 9 < 3"), ("'Disallow: /checkout'", "k % 10 < 3"), ("'Sitemap: https://a/s.xml'", "k % 3 > 0"), ("'Crawl-delay: 5'", "k % 9 = 0"), ("'   '", "k % 2 = 0"),
    ]
)
SQL_RULES = rf"""f AS (SELECT k AS url, {ROBOTS} AS content FROM (SELECT c_custkey AS k FROM customer)),
l AS (SELECT url, trim(line) AS line, n FROM (SELECT url, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS n FROM f) WHERE trim(line) <> ''),
k AS (SELECT url, n, CASE WHEN line LIKE '#%' THEN 'comment' WHEN lower(split_part(line, ':', 1)) IN ('sitemap','user-agent','allow','disallow') THEN lower(split_part(line, ':', 1)) ELSE 'other' END AS kind,
      CASE WHEN line LIKE '#%' THEN trim(substr(line, 2)) ELSE trim(substr(line, instr(line, ':') + 1)) END AS value FROM l),
r AS (SELECT url, n AS line_no, kind, coalesce(last_value(CASE WHEN kind = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY url ORDER BY n ROWS UNBOUNDED PRECEDING), '*') AS user_agent, value FROM k)"""


def _files(spark: SparkSession, sf_dir: str, content: str) -> DataFrame:
    """A file per customer, made from its key."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(F.col("k").alias("url"), F.expr(content).alias("content"))


@register(f"WITH {SQL_RULES} SELECT url, line_no::BIGINT AS line_no, kind, user_agent, value FROM r")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.parse(_files(spark, sf_dir, ROBOTS)).withColumn("line_no", long(F.col("line_no")))


def _texts(missing: str, if_missing: str, rules: list[tuple[str, str]]) -> str:
    """SQL of a list of texts, joined: those whose condition holds, in order."""
    quoted = ", ".join(f"CASE WHEN {when} THEN {text} END" for when, text in rules)
    return f"CASE WHEN {missing} THEN '{if_missing}' ELSE concat_ws('; ', {quoted}) END"


SQL_ROBOTS_ISSUES = _texts("missing", "There is no robots.txt, or it says nothing", [("a = 0", "'No crawler of a language model is addressed by name'"), ("s = 0", "'The sitemap is not named'"), ("p = 0", "'Private areas are open to crawlers'")])
SQL_ROBOTS_ADVICE = _texts(
    "missing",
    "Publish a robots.txt with at least one rule",
    [
        ("a IN (1, 2)", "'Address more crawlers of language models by name: three or more, not ' || a"), ("a = 0", "'Address crawlers of language models by name'"), ("s = 0", "'Name the sitemap in a Sitemap line'"),
        ("p IN (1, 2)", "'Close more of the private areas'"), ("p = 0", "'Close private areas such as accounts and carts by Disallow lines'"), ("NOT m", "'Point to llms.txt in a comment'"), ("c = 0", "'Explain the rules in comments'"),
    ],
)


@register(rf"""WITH {SQL_RULES}, g AS (SELECT url, count(DISTINCT value) FILTER (kind = 'user-agent' AND regexp_matches(lower(value), 'gptbot|claudebot|cohere-ai')) AS a, count(*) FILTER (kind = 'sitemap') AS s,
 count(DISTINCT value) FILTER (kind = 'disallow' AND regexp_matches(lower(value), '^/(admin|cart|user|checkout)')) AS p, coalesce(bool_or(kind = 'comment' AND contains(lower(value), 'llms.txt')), false) AS m, count(*) FILTER (kind = 'comment') AS c FROM r GROUP BY 1),
w AS (SELECT url, coalesce(content, '') = '' AS missing, coalesce(a, 0) AS a, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(m, false) AS m, coalesce(c, 0) AS c FROM f LEFT JOIN g USING (url)),
x AS (SELECT *, CASE WHEN missing THEN 0 ELSE least(100, CASE WHEN a >= 3 THEN 30 WHEN a >= 1 THEN 20 ELSE 5 END + CASE WHEN s > 0 THEN 20 ELSE 0 END + CASE WHEN p >= 3 THEN 25 WHEN p >= 1 THEN 15 ELSE 0 END + CASE WHEN m THEN 15 ELSE 0 END + CASE WHEN c >= 3 THEN 10 WHEN c >= 1 THEN 5 ELSE 0 END + CASE WHEN a > 0 AND s > 0 AND p > 0 AND m THEN 10 ELSE 0 END) END AS score FROM w)
SELECT url, score::BIGINT AS score, CASE WHEN missing THEN 'Missing' WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Poor' END AS quality, {SQL_ROBOTS_ISSUES} AS issues, {SQL_ROBOTS_ADVICE} AS recommendations FROM x""")
def robots_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robots.quality(_files(spark, sf_dir, ROBOTS))
    return found.select("url", long(F.col("score")).alias("score"), "quality", F.array_join("issues", "; ").alias("issues"), F.array_join("recommendations", "; ").alias("recommendations"))


RULES = [("*", "disallow", "/fr/"), ("*", "allow", "/fr/1*"), ("*", "disallow", "/*.html$"), ("*", "allow", "/de/*.html$"), ("webloom", "disallow", "/es/2"), ("other", "disallow", "/"), ("*", "disallow", "/*?")]
SQL_MATCH = [("^/fr/", 4, 0), ("^/fr/1.*", 6, 1), ("^/.*\\.html$", 8, 0), ("^/de/.*\\.html$", 11, 1), ("^/es/2", 5, 0), ("^/.*\\?", 3, 0)]


@register(
    "WITH p AS (SELECT url, CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) END AS path FROM pages), "
    "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}, {a})" for p, n, a in SQL_MATCH) + ") t(regex, n, allow)), m AS (SELECT url, arg_max(allow, n * 2 + allow) AS allow FROM p JOIN r ON regexp_matches(path, regex) GROUP BY url) SELECT p.url, coalesce(allow, 1) = 1 AS allowed FROM p LEFT JOIN m USING (url)"
)
def robots_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "user_agent string, kind string, value string")
    return robots.allowed(table(spark, sf_dir, "pages").select("url"), rules, user_agent="webloom").select("url", "allowed")


LLMS = _lines(
    [
        ("'short'", "k % 8 = 0"), ("'# Shop ' || k", "k % 5 > 0"), ("'**Bold words that are long enough.**'", "k % 3 = 0"), ("'A shop that sells many useful things.'", "k % 2 = 0"), ("'- **Contact:** x@y.z'", "k % 3 = 0"), ("'**Last updated**: 2024'", "k % 4 = 0"),
        ("'the site type: shop'", "k % 6 < 2"), ("'## Access guidelines'", "k % 2 = 0"), ("'Rate 10 per hour'", "k % 3 = 1"), ("'use the endpoint'", "k % 7 = 2"), ("'## Restrictions'", "k % 5 < 2"), ("'####### API'", "k % 7 < 3"),
        ("'### Training data usage'", "k % 4 < 2"), ("'##Attribution'", "k % 3 = 0"), ("'## Citation and credit'", "k % 9 < 4"), ("'## Errors'", "k % 9 = 0"), ("'[a](/a) [b](/b c)'", "k % 2 = 1"), ("'[c](/c) [d](/api) [e](/e)'", "k % 3 = 2"), ("repeat('word ', cast(k % 230 as int))", "k % 2 = 0"),
    ]
)
SQL_SECTIONS = [("access guidelines", "access|guidelines|rate limit|usage"), ("content restrictions", "restrictions|prohibited|disallow|off-limits"), ("api access", "api|endpoint|authentication"), ("training guidelines", "training|machine learning|data usage"), ("attribution", "attribution|credit|citation"), ("error handling", "error|retry|fallback")]
SQL_LLMS_ISSUES = _texts("missing", "There is no llms.txt, or it has no heading", [("NOT t", "'The site is not named in a first heading'"), ("NOT d", "'What the site is for is not said'"), ("NOT c", "'Nobody is named to ask'"), ("NOT u", "'The date of the last change is not given'"), ("w < 50", "'The text has fewer than 50 words'"), ("n = 0", "'Nothing is linked'")])
SQL_LLMS_ADVICE = _texts(
    "missing",
    "Publish an llms.txt that begins with a heading",
    [
        ("NOT t", "'Begin with a heading that names the site'"), ("NOT d", "'Say in a sentence or two what the site is for'"), ("NOT c", "'Name an address for questions on access'"), ("NOT u", "'Give the date of the last change'"),
        *((f"NOT s{k}", f"'Write a section on {name}'") for k, (name, _) in enumerate(SQL_SECTIONS)),
        ("w >= 100 AND w < 200", "'Go into more detail than ' || w || ' words allow'"), ("w >= 50 AND w < 100", "'Write the sections out'"), ("n IN (3, 4)", "'Link to a few more documents'"), ("n IN (1, 2)", "'Link to the documents that matter most'"),
        ("n = 0", "'Link to documents on interfaces and rules'"), ("z = 1", "'Name one more fact that programs need, such as limits or paths'"), ("z = 0", "'Name the facts that programs need: limits, addresses, closed paths'"), ("NOT y", "'Say what type of site it is'"),
    ],
)


@register(rf"""WITH f AS (SELECT k AS url, {LLMS} AS content FROM (SELECT c_custkey AS k FROM customer)), l AS (SELECT url, coalesce(content, '') AS text, list_transform(string_split(coalesce(content, ''), chr(10)), lambda s: trim(s)) AS lines FROM f),
h AS (SELECT *, list_filter(lines, lambda s: NOT starts_with(s, '#')) AS plain, list_transform(list_filter(lines, lambda s: regexp_matches(s, '^#+\s+\S')), lambda s: lower(regexp_replace(s, '^#+\s+', ''))) AS headings, list_position(list_transform(lines, lambda s: starts_with(s, '# ')), true) AS spot FROM l),
g AS (SELECT url, text = '' AS missing, spot IS NOT NULL AS t, spot IS NOT NULL AND len(list_filter(lines[spot + 1:], lambda s: length(s) > 20 AND NOT starts_with(s, '#') AND NOT starts_with(s, '**'))) > 0 AS d,
 len(list_filter(plain, lambda s: regexp_matches(lower(s), 'contact(\*\*)?:'))) > 0 AS c, len(list_filter(plain, lambda s: regexp_matches(lower(s), 'last updated(\*\*)?:'))) > 0 AS u, len(list_filter(plain, lambda s: regexp_matches(lower(s), 'site type(\*\*)?:'))) > 0 AS y,
 """ + ", ".join(f"len(list_filter(headings, lambda s: regexp_matches(s, '{words}'))) > 0 AS s{k}" for k, (_, words) in enumerate(SQL_SECTIONS)) + r""",
 len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '')) AS w, len(regexp_extract_all(text, '\[[^\]]+\]\([^)]+\)')) AS n, len(headings) AS q,
 (contains(lower(text), 'rate') AND (contains(text, 'per hour') OR contains(text, 'per minute')))::INT + (contains(lower(text), 'endpoint') OR contains(lower(text), 'api/'))::INT + (contains(text, '/') AND (contains(text, 'admin') OR contains(text, 'api')))::INT AS z FROM h),
x AS (SELECT *, s0::INT + s1::INT + s2::INT + s3::INT + s4::INT + s5::INT AS sections FROM g),
v AS (SELECT *, CASE WHEN missing THEN 0 ELSE least(100, 10 * (t::INT + d::INT + c::INT + u::INT) + 5 * sections + CASE WHEN w >= 200 THEN 15 WHEN w >= 100 THEN 10 WHEN w >= 50 THEN 5 ELSE 0 END + CASE WHEN n >= 5 THEN 10 WHEN n >= 3 THEN 7 WHEN n >= 1 THEN 4 ELSE 0 END + CASE WHEN z >= 2 THEN 5 WHEN z = 1 THEN 3 ELSE 0 END + CASE WHEN y THEN 3 ELSE 0 END + CASE WHEN q >= 5 THEN 2 ELSE 0 END) END AS score FROM x)
""" + f"""SELECT url, score::BIGINT AS score, CASE WHEN missing THEN 'Missing' WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair' WHEN score >= 30 THEN 'Poor' ELSE 'Very Poor' END AS quality, sections::BIGINT AS sections, n::BIGINT AS n_links, q::BIGINT AS n_headings, {SQL_LLMS_ISSUES} AS issues, {SQL_LLMS_ADVICE} AS recommendations FROM v""")
def llms_txt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = llms_txt.quality(_files(spark, sf_dir, LLMS))
    return found.select("url", "quality", *[long(F.col(c)).alias(c) for c in ("score", "sections", "n_links", "n_headings")], F.array_join("issues", "; ").alias("issues"), F.array_join("recommendations", "; ").alias("recommendations"))


SQL_PATTERNS = [
    ("structured_data", "n_structured > 0"),
    ("semantic", "has_main::INT + has_nav::INT + has_header::INT + has_footer::INT + has_article::INT + has_section::INT >= 4"),
    ("forms", "n_forms > 0 AND n_standard_names > 0"),
    ("errors", "has_persistent_errors"),
    ("state", "has_validation OR has_loading OR has_agent_visible"),
    ("llms_txt", "has_llms_txt"),
]
#: Further measures of an order taken as a page, for both engines.
PATTERN_COLUMNS = {"n_structured": "page * 3 % 5", "n_forms": "page % 3", "n_standard_names": "page % 5", "robots_score": "page * 7 % 101", "n_required": "page * 5 % 3", "has_live": "page * 3 % 7 < 4", "has_alert": "page * 5 % 11 < 5"}
SQL_PATTERN_SERVED = sql_points([("has_main", 5), ("has_nav", 3), ("has_header", 3), ("has_footer", 3), ("has_article", 3), ("has_section", 3), ("has_llms_txt", 10), ("has_hsts", 3), ("has_csp", 3), ("has_frame_options", 2), ("has_content_type_options", 2)]) + " + least(25, 8 * n_structured) + CASE WHEN n_forms > 0 THEN floor(15 * (n_standard_names::DOUBLE / greatest(n_inputs, 1)) + 0.5) ELSE 0 END + floor(robots_score::DOUBLE / 100 * 15 + 0.5)"
SQL_PATTERN_RENDERED = sql_points([("has_validation", 10), ("has_loading", 10), ("has_agent_visible", 10), ("n_required > 0", 20), ("has_persistent_errors", 25), ("has_live", 10), ("has_invalid", 10), ("has_alert", 5)])


@register(
    f"WITH {SQL_PAGES}, q AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in PATTERN_COLUMNS.items()) + f" FROM p), s AS (SELECT *, least(100, {SQL_PATTERN_SERVED})::DOUBLE AS served, least(100, {SQL_PATTERN_RENDERED})::DOUBLE AS rendered FROM q), g AS (SELECT *, served + rendered AS score FROM s WHERE served >= 60 AND rendered >= 60), x AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS pattern, page, score FROM g WHERE {c}" for n, c in SQL_PATTERNS)
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY score DESC, page) AS rank FROM x) SELECT pattern, rank, page AS url, score::DOUBLE AS score FROM r WHERE rank <= 5"
)
def exemplary_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of at most five exemplary pages per pattern, by the selection's own scores."""
    # measures go into one struct: a filter over many aliased flags would make the optimizer try every mix of names
    flags = _pages(spark, sf_dir)
    flags = flags.select("*", *[F.expr(v).alias(k) for k, v in PATTERN_COLUMNS.items()])
    rows = flags.select(F.col("page").alias("url"), F.struct(*flags.columns[1:]).alias("m"))
    m = {c: F.col(f"m.{c}") for c in flags.columns[1:]}
    rows = rows.withColumns({"served_score": patterns.served_score(m), "rendered_score": patterns.rendered_score(m)})
    return patterns.extract(rows, 60, 60, column=m.__getitem__).select("pattern", long(F.col("rank")).alias("rank"), "url", F.col("score").cast("double").alias("score"))


def _performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(k, F.when(k % 9 != 0, v * 30).alias("load_time"), (v * 40).alias("lcp"), (v * 20).alias("fcp"), F.when(k % 2 == 0, v / 500).alias("cls"), F.col("user_id"))


SQL_PERF = "f AS (SELECT event_id, user_id, CASE WHEN event_id % 9 <> 0 THEN value * 30 END AS load_time, value * 40 AS lcp, value * 20 AS fcp, CASE WHEN event_id % 2 = 0 THEN value / 500 END AS cls FROM events)"


SQL_PERF_CASES = "c AS (SELECT 'all' AS kind, load_time, lcp, fcp, cls FROM f UNION ALL SELECT 'load time only', load_time * 5, NULL, NULL, NULL FROM f UNION ALL SELECT 'no paint', load_time / 9, 0 * lcp, 0 * fcp, cls / 99 FROM f UNION ALL SELECT 'slow', load_time * 9, lcp * 9, fcp * 9, NULL FROM f)"


@register(f"""WITH {SQL_PERF}, {SQL_PERF_CASES}, a AS (SELECT kind, avg(coalesce(load_time, 0)) AS load_time, avg(coalesce(lcp, 0)) AS lcp, avg(coalesce(fcp, 0)) AS fcp, avg(coalesce(cls, 0)) AS cls, bool_or(coalesce(lcp, 0) > 0) AS has_lcp, bool_or(cls IS NOT NULL) AS has_cls FROM c GROUP BY kind),
s AS (SELECT *, floor(100.0 * (CASE WHEN load_time < 1000 THEN 25 WHEN load_time < 2000 THEN 20 WHEN load_time < 3000 THEN 15 ELSE 0 END + CASE WHEN NOT has_lcp THEN 0 WHEN lcp < 2500 THEN 25 WHEN lcp < 4000 THEN 15 ELSE 0 END
 + CASE WHEN fcp < 1800 THEN 25 WHEN fcp < 3000 THEN 15 ELSE 0 END + CASE WHEN NOT has_cls THEN 0 WHEN cls < 0.1 THEN 25 WHEN cls < 0.25 THEN 15 ELSE 0 END) / (50 + 25 * has_lcp::INT + 25 * has_cls::INT) + 0.5)::BIGINT AS score FROM a)
SELECT kind, round(load_time, 6) AS load_time, round(lcp, 6) AS lcp, round(fcp, 6) AS fcp, round(cls, 6) AS cls, score, CASE WHEN score >= 75 THEN 'Excellent' WHEN score >= 50 THEN 'Good' WHEN score >= 25 THEN 'Fair' ELSE 'Needs Improvement' END AS status FROM s""")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of four sites made of all events: everything measured, load times only, no paint and a steady layout, slow without layout shifts."""
    f, out = _performance(spark, sf_dir), None
    nothing = F.lit(None).cast("double")
    cases = {
        "all": {},
        "load time only": {"load_time": F.col("load_time") * 5, "lcp": nothing, "fcp": nothing, "cls": nothing},
        "no paint": {"load_time": F.col("load_time") / 9, "lcp": 0 * F.col("lcp"), "fcp": 0 * F.col("fcp"), "cls": F.col("cls") / 99},
        "slow": {"load_time": F.col("load_time") * 9, "lcp": F.col("lcp") * 9, "fcp": F.col("fcp") * 9, "cls": nothing},
    }
    for kind, columns in cases.items():
        found = rollups.performance_summary(f.withColumns(columns) if columns else f)
        part = found.select(F.lit(kind).alias("kind"), *[six(F.col(c)).alias(c) for c in ("load_time", "lcp", "fcp", "cls")], "score", "status")
        out = part if out is None else out.unionByName(part)
    return out


@register(f"WITH {SQL_PERF} SELECT metric, round(avg(v), 6) AS average, round(min(v), 6) AS least, round(max(v), 6) AS most FROM (SELECT 'load_time' AS metric, load_time AS v FROM f UNION ALL SELECT 'lcp', lcp FROM f UNION ALL SELECT 'cls', cls FROM f) GROUP BY metric")
def performance_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollups.summarize(_performance(spark, sf_dir), ["load_time", "lcp", "cls"])
    return found.select("metric", *[six(F.col(c)).alias(c) for c in ("average", "least", "most")])


@register(f"""WITH {SQL_PERF}, a AS (SELECT user_id, 'load_time' AS metric, avg(load_time) AS v FROM f GROUP BY 1 UNION ALL SELECT user_id, 'lcp', avg(lcp) FROM f GROUP BY 1 UNION ALL SELECT user_id, 'cls', avg(cls) FROM f GROUP BY 1),
t AS (SELECT * FROM (VALUES ('load_time', 3000, 5000), ('lcp', 2500, 4000), ('cls', 0.1, 0.25)) t(metric, good, fair)) SELECT user_id, metric, CASE WHEN v <= good THEN 'pass' WHEN v <= fair THEN 'warn' ELSE 'fail' END AS status FROM a JOIN t USING (metric)""")
def threshold_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's averages against the thresholds table; the table has a fixed number of rows, and Catalyst broadcasts it by its size."""
    from webloom.functions.numbers import pass_warn_fail

    means = _performance(spark, sf_dir).groupBy("user_id").agg(*[F.avg(c).alias(c) for c in ("load_time", "lcp", "cls")]).unpivot("user_id", ["load_time", "lcp", "cls"], "metric", "value")
    limits = tables.thresholds(spark).filter("category = 'performance'")
    return means.join(limits, "metric").select("user_id", "metric", pass_warn_fail(F.col("value"), F.col("pass"), F.col("warn"), F.col("higher_is_better")).alias("status"))


@register(f"""WITH {SQL_PERF} SELECT user_id, round(sum(greatest(load_time - 50, 0)), 6) AS tbt, round(sum(cls) FILTER (event_id % 3 <> 0), 6) AS cls, max(lcp) AS lcp FROM f GROUP BY user_id""")
def observer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocking time, layout shift without recent input, and largest paint from an entry table."""
    rows = _performance(spark, sf_dir)
    return rows.groupBy("user_id").agg(six(F.sum(F.greatest(F.col("load_time") - 50, F.lit(0.0)) * F.when(F.col("load_time").isNotNull(), 1))).alias("tbt"), six(F.sum(F.when(F.col("event_id") % 3 != 0, F.col("cls")))).alias("cls"), F.max("lcp").alias("lcp"))


#: Customers taken as pages for the report's sections, for both engines.
SECTION_COLUMNS = {
    "url": "concat(CASE WHEN k % 4 = 0 THEN 'http' ELSE 'https' END, '://a.com/', CASE WHEN k % 6 = 0 THEN 'Up_x' ELSE 'low' END, CASE WHEN k % 13 = 0 THEN 'é z' ELSE '' END, '/', k, repeat('q', cast(k % 9 * 15 as int)))", "status_code": "cast(200 + 100 * (k % 5) - 100 * (k % 2) + k % 3 as int)", "is_internal": "k % 7 > 0", "indexable": "k % 3 > 0",
    "title": "CASE WHEN k % 8 > 0 THEN repeat('t', cast(k % 90 as int)) END", "meta_description": "CASE WHEN k % 9 > 0 THEN repeat('m', cast(k % 230 as int)) END", "h1_count": "k % 4", "images": "CASE WHEN k % 5 > 0 THEN k % 12 END", "images_without_alt": "k % 3",
    "internal_links": "k % 6", "external_links": "k % 140", "has_hsts": "k % 2 = 0", "has_csp": "CASE WHEN k % 3 > 0 THEN k % 3 = 1 END", "has_frame_options": "k % 5 = 0", "has_content_type_options": "k % 7 = 0", "hreflangs": "k % 3", "canonical": "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://a.com/other' ELSE concat('https://a.com/low/', k, repeat('q', cast(k % 9 * 15 as int))) END",
    "word_count": "k % 700", "js_errors": "CASE WHEN k % 10 = 0 THEN 2 END",
}
SQL_SECTIONS_PAGES = "x AS (SELECT " + ", ".join(f"{v} AS {c}" for c, v in SECTION_COLUMNS.items()) + " FROM (SELECT c_custkey AS k FROM customer))"


def _sql_sections(items: list[tuple[str, str, str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT {k}::BIGINT AS position, '{section}' AS section, '{item}' AS item, ({value})::DOUBLE AS value, {f'round(100 * (({value})::DOUBLE / ({total})), 2)' if total else 'NULL::DOUBLE'} AS percent FROM x" for k, (section, item, value, total) in enumerate(items))
    return f"WITH {SQL_SECTIONS_PAGES} {rows}"


def _when(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select(*[F.expr(v).alias(c) for c, v in SECTION_COLUMNS.items()])


@register(_sql_sections([
    ("Summary", "Total URLs", "count(*)", "count(*)"), ("Summary", "Internal URLs", _when("is_internal"), "count(*)"), ("Summary", "External URLs", _when("NOT is_internal"), "count(*)"), ("Summary", "Indexable URLs", _when("is_internal AND indexable"), "count(*)"), ("Summary", "Non-Indexable URLs", _when("is_internal AND NOT indexable"), "count(*)"),
    *(("Response Codes", f"{k}xx", _when(f"status_code // 100 = {k}"), "count(*)") for k in (2, 3, 4, 5)),
    ("URL Analysis", "URLs with non-ASCII characters", _when("strlen(url) > length(url)"), "count(*)"), ("URL Analysis", "URLs with uppercase characters", _when("regexp_matches(url, '[A-Z]')"), "count(*)"), ("URL Analysis", "URLs with underscores", _when("contains(url, '_')"), "count(*)"), ("URL Analysis", "URLs with spaces", _when("contains(url, ' ')"), "count(*)"), ("URL Analysis", "URLs over 115 characters", _when("length(url) > 115"), "count(*)"),
]))
def address_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.address_sections(_section_pages(spark, sf_dir)).withColumn("position", long(F.col("position")))


@register(_sql_sections([
    ("Page Title Analysis", "Missing titles", _when("coalesce(title, '') = ''"), "count(*)"), ("Page Title Analysis", "Titles over 60 characters", _when("length(title) > 60"), "count(*)"), ("Page Title Analysis", "Titles under 30 characters", _when("length(title) < 30 AND title <> ''"), "count(*)"),
    ("Meta Description Analysis", "Missing meta descriptions", _when("coalesce(meta_description, '') = ''"), "count(*)"), ("Meta Description Analysis", "Meta descriptions over 155 characters", _when("length(meta_description) > 155"), "count(*)"), ("Meta Description Analysis", "Meta descriptions under 70 characters", _when("length(meta_description) < 70 AND meta_description <> ''"), "count(*)"),
    ("Heading Analysis", "Missing H1", _when("h1_count = 0"), "count(*)"), ("Heading Analysis", "Multiple H1s", _when("h1_count > 1"), "count(*)"), ("Image Analysis", "Total images", "sum(images)", "sum(images)"), ("Image Analysis", "Images missing alt text", "sum(images_without_alt)", "sum(images)"),
    ("Link Analysis", "Pages without internal links", _when("internal_links = 0"), "count(*)"), ("Link Analysis", "Pages with high number of external links", _when("external_links > 100"), "count(*)"), ("Security Analysis", "HTTP URLs (non-secure)", _when("url LIKE 'http:%'"), "count(*)"), ("Security Analysis", "Missing HSTS header", _when("has_hsts IS NOT TRUE"), "count(*)"),
    ("Security Analysis", "Missing Content Security Policy", _when("has_csp IS NOT TRUE"), "count(*)"), ("Security Analysis", "Missing X-Frame-Options header", _when("has_frame_options IS NOT TRUE"), "count(*)"), ("Security Analysis", "Missing X-Content-Type-Options header", _when("has_content_type_options IS NOT TRUE"), "count(*)"), ("Hreflang Analysis", "Pages with hreflang", _when("hreflangs > 0"), "count(*)"),
    ("Canonical Analysis", "Pages with canonical tags", "count(canonical)", "count(*)"), ("Canonical Analysis", "Self-referencing canonicals", _when("canonical = url"), "count(*)"), ("Canonical Analysis", "Non-self canonicals", _when("canonical <> url"), "count(*)"), ("Canonical Analysis", "Missing canonical tags", _when("canonical IS NULL"), "count(*)"),
    ("Content Analysis", "Low content pages", _when("word_count < 300"), "count(*)"), ("Content Analysis", "Average word count", "floor(avg(word_count) + 0.5)", ""), ("JavaScript Errors Analysis", "Pages with JavaScript errors", _when("js_errors > 0"), "count(*)"),
]))
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.page_sections(_section_pages(spark, sf_dir)).withColumn("position", long(F.col("position")))


#: Summaries of sites, for both engines: a customer as a site, its orders as pages.
SITE_COLUMNS = {
    "load_time": "CASE WHEN n > 0 THEN cast(t % 6000 as double) END", "lcp": "CASE WHEN n > 0 THEN cast(t % 5000 as double) END", "errors": "n % 3", "seo_score": "CASE WHEN n > 0 THEN (t % 1000) / 10.0e0 END", "pages": "n", "low_content_pages": "few",
    "pages_without_description": "few % 4", "has_llms_txt": "k % 2 = 0", "llm_pages": "n", "served_score": "cast(t % 97 as double)", "robots_exists": "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END", "robots_score": "k % 100", "robots_quality": "CASE WHEN k % 100 >= 40 THEN 'Fair' ELSE 'Poor' END",
    "robots_advice": "CASE WHEN k % 5 > 0 THEN concat('advice ', k) END", "llms_exists": "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END", "llms_score": "k % 90", "llms_quality": "CASE WHEN k % 90 >= 50 THEN 'Fair' ELSE 'Poor' END", "llms_advice": "CASE WHEN k % 7 > 0 THEN concat('hint ', k) END",
}
SQL_SITES = "o AS (SELECT o_custkey AS k, count(*) AS n, sum(o_orderkey) AS t, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS few FROM orders GROUP BY 1), a AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, coalesce(t, 0) AS t, coalesce(few, 0) AS few FROM customer LEFT JOIN o ON c_custkey = k), z AS (SELECT k AS site, " + ", ".join(f"{v} AS {c}" for c, v in SITE_COLUMNS.items()) + " FROM a)"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(k).alias("n"), F.sum(k).alias("t"), F.count_if(k % 4 == 0).alias("few"))
    sites = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").fillna(0).withColumnRenamed("c_custkey", "k")
    return sites.select(F.col("k").alias("site"), *[F.expr(v).alias(c) for c, v in SITE_COLUMNS.items()])


def _sql_rules(rules: list[tuple[str, str, str, str]], rank: str, text: str) -> str:
    return f"WITH {SQL_SITES} " + " UNION ALL ".join(f"SELECT site, {k}::BIGINT AS position, '{category}' AS category, {level} AS {rank}, {said} AS {text} FROM z WHERE {when}" for k, (category, level, when, said) in enumerate(rules))


@register(_sql_rules([
    ("Performance", "'High'", "load_time > 3000", "'Pages take ' || floor(load_time + 0.5)::BIGINT || ' ms to load on average; 3000 ms is the limit'"),
    ("Accessibility", "'Critical'", "errors > 0", "'Accessibility errors on all pages together: ' || errors"),
    ("SEO", "'Medium'", "seo_score < 70", "'The average search score is ' || floor(seo_score + 0.5)::BIGINT || '; it should reach 70'"),
    ("Content", "'Medium'", "low_content_pages > pages * 0.2", "'Pages of fewer than 300 words: ' || low_content_pages || ', a share of ' || floor(100 * (low_content_pages::DOUBLE / pages) + 0.5)::BIGINT || '%'"),
    ("LLM Suitability", "'Low'", "NOT has_llms_txt AND llm_pages > 0", "'The site tells language models nothing of itself, as it has no llms.txt'"),
    ("AI Compatibility", "CASE WHEN robots_score < 40 THEN 'Medium' ELSE 'Low' END", "robots_exists AND robots_score < 60", "'The robots.txt is rated ' || robots_quality || ', ' || robots_score || ' of 100 points'"),
    ("AI Compatibility", "'Low'", "NOT robots_exists", "'The site has no robots.txt'"),
    ("AI Compatibility", "CASE WHEN llms_score < 50 THEN 'Medium' ELSE 'Low' END", "llms_exists AND llms_score < 70", "'The llms.txt is rated ' || llms_quality || ', ' || llms_score || ' of 100 points'"),
    ("AI Compatibility", "'Low'", "NOT llms_exists", "'The site has no llms.txt'"),
], "severity", "finding"))
def key_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.findings(_sites(spark, sf_dir), ["site"]).withColumn("position", long(F.col("position")))


@register(_sql_rules([
    ("Performance", "'High'", "lcp > 2500", "'Let the largest element appear sooner: serve smaller images and load scripts after it'"),
    ("Accessibility", "'Critical'", "errors > 0", "'Mend the accessibility errors before anything else'"),
    ("SEO", "'Medium'", "pages_without_description > 0", "'Write a description for each page that has none; there are ' || pages_without_description"),
    ("Content", "'Medium'", "low_content_pages > 0", "'Say more on short pages, or join them; there are ' || low_content_pages"),
    ("LLM Suitability", "'Low'", "served_score < 50 AND llm_pages > 0", "'Mark the parts of pages by their elements and describe their subject in JSON-LD'"),
    ("AI Compatibility", "CASE WHEN robots_score < 40 THEN 'Medium' ELSE 'Low' END", "robots_exists AND robots_score < 60 AND robots_advice IS NOT NULL", "'robots.txt: ' || robots_advice"),
    ("AI Compatibility", "'Low'", "NOT robots_exists", "'Publish a robots.txt that names the crawlers of language models and the sitemap'"),
    ("AI Compatibility", "CASE WHEN llms_score < 50 THEN 'Medium' ELSE 'Low' END", "llms_exists AND llms_score < 70 AND llms_advice IS NOT NULL", "'llms.txt: ' || llms_advice"),
    ("AI Compatibility", "'Low'", "NOT llms_exists", "'Publish an llms.txt with what the site offers and what may be done with it'"),
], "priority", "recommendation"))
def site_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.recommendations(_sites(spark, sf_dir), ["site"]).withColumn("position", long(F.col("position")))


@register("""WITH s AS (SELECT c_nationkey AS kind, c_acctbal / 100 AS score, c_custkey % 700 AS words, c_custkey % 3 AS h1, c_custkey % 5 AS h2, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 7 END AS h3, (c_custkey % 101)::DOUBLE AS served, (c_custkey % 103)::DOUBLE AS rendered, c_custkey % 6 = 0 AS refers, c_custkey % 50 = 7 AS file FROM customer),
a AS (SELECT count(*) AS pages, avg(score) AS seo, avg(words) AS words, avg(h1 + h2 + coalesce(h3, 0)) AS headings, count(*) FILTER (words < 300) AS low, avg(served) AS served, avg(rendered) AS rendered, count(*) FILTER (refers) AS refer, bool_or(file) AS file FROM s)
SELECT pages, floor(seo + 0.5)::BIGINT AS seo_score, CASE WHEN seo >= 90 THEN 'Excellent' WHEN seo >= 80 THEN 'Very Good' WHEN seo >= 70 THEN 'Good' WHEN seo >= 60 THEN 'Fair' ELSE 'Needs Improvement' END AS seo_status, floor(words + 0.5)::BIGINT AS average_words, round(headings, 1) AS average_headings, low AS low_content_pages, round(100 * (low::DOUBLE / pages), 1) AS low_content_percent,
 floor(served + 0.5)::BIGINT AS served_score, floor(rendered + 0.5)::BIGINT AS rendered_score, CASE WHEN served >= 70 THEN 'Good' WHEN served >= 50 THEN 'Fair' ELSE 'Needs Improvement' END AS agent_status, refer + file::INT AS pages_with_llms_txt, file AS has_llms_txt_file FROM a""")
def site_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, content and agent summaries of customers as pages."""
    k = F.col("c_custkey")
    pages = table(spark, sf_dir, "customer").select(
        (F.col("c_acctbal") / 100).cast("double").alias("score"), (k % 700).alias("word_count"), (k % 3).alias("h1_count"), (k % 5).alias("h2_count"), F.when(k % 4 > 0, k % 7).alias("h3_count"),
        (k % 101).cast("double").alias("served_score"), (k % 103).cast("double").alias("rendered_score"), (k % 6 == 0).alias("has_llms_txt"), F.when(k % 50 == 7, "https://a.com/llms.txt").otherwise("https://a.com/x").alias("url"),
    )
    seo = rollups.seo_score_summary(pages).select(F.col("pages"), F.col("score").alias("seo_score"), F.col("status").alias("seo_status"))
    agent = rollups.agent_summary(pages).withColumnRenamed("status", "agent_status").withColumn("pages_with_llms_txt", long(F.col("pages_with_llms_txt")))
    content = rollups.content_summary(pages)
    return seo.join(content, "pages").join(agent, F.lit(True))


@register("SELECT o_custkey, floor((a + b + c + d) / 4.0 + 0.5)::BIGINT AS score, CASE WHEN floor((a + b + c + d) / 4.0 + 0.5) >= 80 THEN 'Excellent' WHEN floor((a + b + c + d) / 4.0 + 0.5) >= 70 THEN 'Good' WHEN floor((a + b + c + d) / 4.0 + 0.5) >= 60 THEN 'Fair' WHEN floor((a + b + c + d) / 4.0 + 0.5) >= 40 THEN 'Needs Improvement' ELSE 'Critical' END AS label FROM (SELECT o_custkey, count(*) * 5 AS a, max(o_orderkey) % 101 AS b, min(o_orderkey) % 97 AS c, sum(o_orderkey) % 89 AS d FROM orders GROUP BY 1)")
def headline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count(k) * 5).alias("a"), (F.max(k) % 101).alias("b"), (F.min(k) % 97).alias("c"), (F.sum(k) % 89).alias("d"))
    score = rollups.headline_score([F.col(c) for c in "abcd"])
    return parts.select("o_custkey", score.alias("score"), rollups.headline_label(score).alias("label"))


@register("SELECT count(*) AS pages, arg_min(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), page_id) AS site, arg_min(page_id % 2 = 0, page_id) AS tells_last_modified FROM pages")
def site_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.functions import urls

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), urls.host(F.col("url")).alias("host"), F.when(F.col("page_id") % 2 == 0, F.lit("x")).alias("last_modified"))
    return rollups.overview(pages)


@register("SELECT o.o_orderkey AS url FROM orders o WHERE NOT (o_orderkey % 3 = 0 AND o_orderdate + INTERVAL 5 DAY > TIMESTAMP '1996-01-01 00:00:00')")
def fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cached pages, crawled on 1 January 1996; sources of every third are known, changed five days after the order."""
    orders = table(spark, sf_dir, "orders")
    cache = orders.select(F.col("o_orderkey").alias("url"), F.lit("1996-01-01").cast("timestamp").alias("last_crawled"))
    sources = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("url"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 5 days")).alias("last_modified"))
    return tables.fresh(cache, sources).select("url")


@register("""
WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 404 ELSE 200 END AS st FROM events),
z AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 3 AS c, 0.0::DOUBLE AS p, 0 AS e, 0 AS k FROM s UNION ALL
 SELECT z.user_id, s.i,
  CASE WHEN st = 503 AND e + 1 >= 2 THEN greatest(1, c - 1) WHEN st = 200 AND k + 1 >= 10 THEN least(3, c + 1) ELSE c END,
  CASE WHEN st = 503 AND e + 1 >= 2 THEN CASE WHEN p = 0 THEN 1.0 ELSE least(60.0, p * 2) END WHEN st = 200 AND k + 1 >= 10 AND c < 3 THEN p / 2 ELSE p END,
  CASE WHEN st = 503 THEN CASE WHEN e + 1 >= 2 THEN 0 ELSE e + 1 END WHEN st = 200 THEN 0 ELSE e END,
  CASE WHEN st = 200 THEN CASE WHEN k + 1 >= 10 THEN 0 ELSE k + 1 END WHEN st = 503 THEN 0 ELSE k END
 FROM z JOIN s ON s.user_id = z.user_id AND s.i = z.i + 1)
SELECT user_id, i AS fetches, c::BIGINT AS concurrency, p AS pause FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def rate_limiter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as hosts: an error event answers 503, a view 404, anything else 200."""
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", 404).otherwise(200)
    fetches = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), status.alias("status"))
    found = flow.replay(fetches, "user_id", "o", "status")
    return found.select("user_id", long(F.col("fetches")).alias("fetches"), long(F.col("concurrency")).alias("concurrency"), "pause")


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS fetches, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS error_rate FROM events GROUP BY 1, 2")
def status_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"))
    found = fetch_log.status_rates(rows)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@register("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id AS host, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS fetches FROM g GROUP BY user_id, s""")
def fetch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("host"))
    return fetch_log.sessions(rows, gap="12 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@register(f"""SELECT {SQL_FIRST} AS language, count(*) AS pages, min(url) AS example FROM pages GROUP BY 1 HAVING count(*) > 1""")
def language_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.functions import urls

    found = table(spark, sf_dir, "pages").groupBy(urls.first_segment(F.col("url")).alias("language")).agg(F.count(F.lit(1)).alias("pages"), F.min("url").alias("example"))
    return found.filter("pages > 1")


@register("""WITH s AS (SELECT c_acctbal / 100 AS score, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4000 END::DOUBLE AS load_time, (c_custkey % 700)::DOUBLE AS fcp, c_custkey FROM customer), e AS (SELECT CASE event_type WHEN 'view' THEN 'notice' WHEN 'click' THEN 'warning' WHEN 'error' THEN 'error' END AS type FROM events),
a AS (SELECT avg(score) AS a, min(score) AS b, max(score) AS c, avg(load_time) AS l, avg(fcp) AS f, count(*) AS n FROM s),
v AS (SELECT 'Header' AS section, 'https://a.com/' AS item, NULL::DOUBLE AS value, NULL::DOUBLE AS percent, NULL AS kind FROM a UNION ALL
 SELECT 'Orphaned URLs Analysis', 'Orphaned URLs', (SELECT count(*) FROM s WHERE c_custkey % 7 = 0)::DOUBLE, round(100 * ((SELECT count(*) FROM s WHERE c_custkey % 7 = 0)::DOUBLE / n), 2), NULL FROM a UNION ALL
 SELECT 'Accessibility Analysis', 'Total issues', count(*)::DOUBLE, NULL, NULL FROM e UNION ALL SELECT 'Accessibility Analysis', type || ' issues', count(*)::DOUBLE, NULL, NULL FROM e WHERE type IS NOT NULL GROUP BY type UNION ALL
 SELECT 'SEO Score Analysis', 'Average SEO Score', a, NULL, 'seo' FROM a UNION ALL SELECT 'SEO Score Analysis', 'Lowest SEO Score', b, NULL, 'seo' FROM a UNION ALL SELECT 'SEO Score Analysis', 'Highest SEO Score', c, NULL, 'seo' FROM a UNION ALL
 SELECT 'Performance Analysis', 'Average Load Time', l, NULL, 'load' FROM a UNION ALL SELECT 'Performance Analysis', 'Average First Paint', NULL, NULL, 'none' FROM a UNION ALL SELECT 'Performance Analysis', 'Average First Contentful Paint', f, NULL, 'fcp' FROM a)
SELECT section, item, round(value, 2) AS value, percent, CASE kind WHEN 'seo' THEN CASE WHEN value >= 90 THEN 'Excellent' WHEN value >= 80 THEN 'Very good' WHEN value >= 70 THEN 'Good' WHEN value >= 60 THEN 'Fair' WHEN value >= 50 THEN 'Needs improvement' ELSE 'Poor' END
 WHEN 'load' THEN CASE WHEN value <= 1000 THEN 'Excellent' WHEN value <= 2000 THEN 'Good' WHEN value <= 3000 THEN 'Fair' ELSE 'Needs Improvement' END WHEN 'fcp' THEN CASE WHEN value <= 1500 THEN 'Excellent' WHEN value <= 2500 THEN 'Good' WHEN value <= 4000 THEN 'Fair' ELSE 'Needs Improvement' END WHEN 'none' THEN 'N/A' END AS comment FROM v""")
def other_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report sections on orphans, issues, scores and timings, with customers as pages and events as issues."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, (F.col("c_acctbal") / 100).cast("double").alias("score"), F.when(k % 3 > 0, k % 4000).cast("double").alias("load_time"), F.lit(None).cast("double").alias("first_paint"), (k % 700).cast("double").alias("fcp"))
    kind = F.col("event_type")
    issues = table(spark, sf_dir, "events").select(F.when(kind == "view", "notice").when(kind == "click", "warning").when(kind == "error", "error").alias("type"))
    found = rollups.other_sections(rows, rows, rows.filter(k % 7 == 0), issues, "https://a.com/")
    return found.select("section", "item", F.round("value", 2).alias("value"), "percent", "comment")

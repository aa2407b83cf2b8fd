"""Queries that run the scorers over measures made from the driver's tables (orders, line items, customers stand in for page tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import accessibility, agents, content, markup, media, numbers, security, urls
from webloom.operators import rollups
from webloom.plans.page_queries import long, six
from webloom.plans.registry import register
from webloom.sources.tables import table


#: Flags of an order taken as a page: the bits of its key, times a spread constant, by name.
FLAGS = [
    "has_main", "has_nav", "has_header", "has_footer", "has_article", "has_section", "has_schema_org", "has_llms_txt", "has_ai_txt", "has_restrictions", "has_state", "has_agent_visible", "has_validation", "has_loading",
    "has_persistent_errors", "has_invalid", "has_bot_protection", "has_hsts", "has_csp", "has_frame_options", "has_content_type_options", "has_json_ld", "has_microdata", "has_og_title", "has_og_description", "has_og_image", "has_og_type",
]
COUNTS = {"n_tables": 3, "tables_with_scope": 2, "tables_with_caption": 2, "n_inputs": 4, "n_fields": 3, "api_score": 60, "n_main": 2, "n_article": 3, "n_section": 2, "n_nav": 2, "n_h1": 3, "n_h2": 12, "n_h3": 17, "n_h4": 2, "n_h5": 2, "n_h6": 2, "n_lists": 2, "description_length": 120, "paragraphs": 130, "text_length": 60000, "markup_length": 300000, "hidden": 40, "total": 200}
RATIOS = {"name_ratio": 11, "label_ratio": 7, "autocomplete_ratio": 5}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [((F.col("o_orderkey") * (2 * k + 7)) % 11 < 5).alias(n) for k, n in enumerate(FLAGS)]
    counts = [((F.col("o_orderkey") * (k + 3) * 7) % m).alias(n) for k, (n, m) in enumerate(COUNTS.items())]
    ratios = [((F.col("o_orderkey") * (k + 5)) % (m + 1) / m).alias(n) for k, (n, m) in enumerate(RATIOS.items())]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), *flags, *counts, *ratios)


SQL_PAGES = (
    "p AS (SELECT o_orderkey AS page, "
    + ", ".join(f"(o_orderkey * {2 * k + 7}) % 11 < 5 AS {n}" for k, n in enumerate(FLAGS))
    + ", "
    + ", ".join(f"(o_orderkey * {k + 3} * 7) % {m} AS {n}" for k, (n, m) in enumerate(COUNTS.items()))
    + ", "
    + ", ".join(f"((o_orderkey * {k + 5}) % {m + 1})::DOUBLE / {m} AS {n}" for k, (n, m) in enumerate(RATIOS.items()))
    + " FROM orders)"
)


def _served(m: dict[str, Column]) -> Column:
    return agents.served_score(m)


def _columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def sql_points(rules: list[tuple[str, int]]) -> str:
    return " + ".join(f"(CASE WHEN {c} THEN {v} ELSE 0 END)" for c, v in rules)


SQL_SERVED = (
    "least(100, greatest(0, floor("
    + sql_points([("has_main", 6), ("has_nav", 5), ("has_header", 3), ("has_footer", 3), ("has_article OR has_section", 3), ("has_schema_org", 15), ("has_llms_txt", 10), ("has_ai_txt", 5), ("has_restrictions", -5), ("n_tables = 0 OR (tables_with_scope > 0 AND tables_with_caption > 0)", 10)])
    + " + 15 * name_ratio + 10 * label_ratio + 15 * autocomplete_ratio + 0.5)))"
)
SQL_EXTRA = sql_points([("has_state", 7), ("has_validation", 5), ("has_loading", 3), ("has_persistent_errors", 10), ("has_invalid", 5)])


@register(f"WITH {SQL_PAGES}, s AS (SELECT page, {SQL_SERVED}::DOUBLE AS served, {SQL_EXTRA} AS extra FROM p) SELECT page, served, least(100, served + least(30, extra))::DOUBLE AS rendered, CASE WHEN served >= 70 THEN 'good' WHEN served >= 50 THEN 'fair' ELSE 'poor' END AS status FROM s")
def served_and_rendered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pages(spark, sf_dir)
    m = _columns(df)
    served = _served(m).cast("double")
    return df.select("page", served.alias("served"), agents.rendered_score(served, m).cast("double").alias("rendered"), agents.status(served).alias("status"))


SQL_RULES = [
    ("no_main", "NOT has_main"), ("no_nav", "NOT has_nav"), ("field_names", "n_inputs > 0 AND name_ratio < 0.5"), ("field_labels", "n_inputs > 0 AND label_ratio < 0.8"), ("no_schema_org", "NOT has_schema_org"), ("no_llms_txt", "NOT has_llms_txt"),
    ("autocomplete", "n_fields > 0 AND autocomplete_ratio < 0.5"), ("robots_restrictions", "has_restrictions"), ("no_ai_txt", "NOT has_ai_txt"), ("no_data_state", "page % 2 = 0 AND NOT has_state"), ("no_agent_visible", "page % 2 = 0 AND NOT has_agent_visible"),
    ("no_persistent_errors", "page % 2 = 0 AND NOT has_persistent_errors"), ("bot_protection", "has_bot_protection"), ("api_discovery", "api_score < 25"), ("table_scope", "n_tables > 0 AND tables_with_scope = 0"),
]


@register(f"WITH {SQL_PAGES}, f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule FROM p WHERE {c}" for n, c in SQL_RULES) + ") SELECT rule, count(*) AS pages FROM f GROUP BY rule")
def agent_feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pages(spark, sf_dir)
    return df.select(F.explode(agents.feedback(_columns(df), F.col("page") % 2 == 0)).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("pages"))


@register(f"WITH {SQL_PAGES} SELECT page, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in SQL_RULES) + ") AS rules FROM p")
def agent_feedback_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pages(spark, sf_dir)
    return df.select("page", F.array_join(agents.feedback(_columns(df), F.col("page") % 2 == 0), ",").alias("rules"))


#: Texts by rule, for the second engine.
SQL_TEXTS = {
    "no_main": ("'The page does not mark where its content is'", "Put the content of the page into one <main> element"), "no_nav": ("'The page does not mark its menus'", "Put every menu into a <nav> element"),
    "field_names": ("'Form fields with a usual name: ' || floor(100 * name_ratio + 0.5)::BIGINT || '%'", "Name fields by what they ask for, as other sites do (email, phone, city)"), "field_labels": ("'Form fields that nothing labels: ' || floor(100 * (1 - label_ratio) + 0.5)::BIGINT || '%'", "Give each field a label of its own, seen or in aria-label"),
    "no_schema_org": ("'Nothing on the page is described in the Schema.org vocabulary'", "Describe what the page is about in a JSON-LD block"), "no_llms_txt": ("'Language models find no llms.txt from here'", "Publish /llms.txt and link to it from the page"),
    "autocomplete": ("'Form fields with a completion hint: ' || floor(100 * autocomplete_ratio + 0.5)::BIGINT || '%'", 'Say in autocomplete what each field is for'), "robots_restrictions": ("'The robots meta tag keeps programs from indexing or following'", "Keep noindex, nofollow and noarchive to pages that nobody should find"),
    "no_ai_txt": ("'The page names no ai.txt'", "Publish /ai.txt with what models may do with the content, and link to it"), "no_data_state": ("'Elements that change do not tell their state'", "Write the state of changing elements into data-state"),
    "no_agent_visible": ("'The page does not say which elements are meant for programs'", "Mark elements with data-agent-visible, true or false"), "no_persistent_errors": ("'Nothing shows that error messages stay on the page'", 'Show errors in an element with role="alert" inside an aria-live region, until they are mended'),
    "bot_protection": ("'The page checks for programs: ' || CASE WHEN page % 3 = 0 THEN 'reCAPTCHA' ELSE 'None' END", "Offer a way in that needs no challenge, such as an interface with keys"), "api_discovery": ("'Programs hardly find an interface from here'", "Link to documentation of the interface and to its OpenAPI file"),
    "table_scope": ("'Table headers do not say what they head'", 'Give table headers a scope, row or col'),
}


@register(f"WITH {SQL_PAGES} " + " UNION ALL ".join(f"SELECT page, '{n}' AS rule, {SQL_TEXTS[n][0]} AS issue, '{SQL_TEXTS[n][1]}' AS recommendation FROM p WHERE {c}" for n, c in SQL_RULES))
def agent_feedback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said about each page that breaks a rule, and what to do."""
    df = _pages(spark, sf_dir)
    m = _columns(df) | {"captcha_type": F.when(F.col("page") % 3 == 0, "reCAPTCHA").otherwise("None")}
    return df.select("page", F.inline(agents.feedback_details(m, F.col("page") % 2 == 0))).select("page", "rule", "issue", "recommendation")


SQL_READ = {
    "structural": "least(100, " + sql_points([("n_main > 0", 10), ("n_article > 0", 10), ("n_section > 0", 5), ("has_header", 5), ("has_footer", 5), ("n_nav > 0", 5), ("n_h1 = 1", 20), ("n_h2 > 0", 10), ("n_h3 > 0", 5), ("n_h4 + n_h5 + n_h6 > 0", 5), ("n_lists > 0", 10), ("n_tables > 0", 10)]) + ")",
    "organization": "least(100, 50 + CASE WHEN paragraphs = 0 THEN 5 WHEN paragraphs < 100 THEN 25 ELSE 15 END + CASE WHEN text_length > 100 AND text_length < 50000 THEN 25 WHEN text_length >= 50000 THEN 15 ELSE 5 END)",
    "metadata": "least(100, " + sql_points([("has_json_ld", 20), ("has_microdata", 20), ("has_og_title", 10), ("has_og_description", 10), ("has_og_image", 10), ("has_og_type", 10)]) + " + CASE WHEN description_length > 50 THEN 20 WHEN description_length > 0 THEN 10 ELSE 0 END)",
    "extractability": "least(100, 50 + CASE WHEN 100.0 * text_length / nullif(markup_length, 0) > 10 THEN 30 WHEN 100.0 * text_length / nullif(markup_length, 0) > 5 THEN 20 WHEN 100.0 * text_length / nullif(markup_length, 0) > 2 THEN 10 ELSE 0 END + CASE WHEN coalesce(100.0 * hidden / nullif(total, 0), 0) < 5 THEN 20 WHEN coalesce(100.0 * hidden / nullif(total, 0), 0) < 10 THEN 10 WHEN coalesce(100.0 * hidden / nullif(total, 0), 0) < 20 THEN 5 ELSE 0 END)",
}
SQL_READABILITY = f"WITH {SQL_PAGES}, r AS (SELECT page, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in SQL_READ.items()) + " FROM p), o AS (SELECT *, floor((structural + organization + metadata + extractability) / 4 + 0.5)::BIGINT AS overall FROM r) "


def _readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pages(spark, sf_dir)
    m = _columns(df) | {"n_header": F.col("has_header").cast("int"), "n_footer": F.col("has_footer").cast("int")}
    rows = df.select(
        "page",
        agents.structural(m).alias("structural"),
        agents.organization(m["paragraphs"], m["text_length"]).alias("organization"),
        agents.metadata(m).alias("metadata"),
        agents.extractability(m["text_length"], m["markup_length"], m["hidden"], m["total"]).alias("extractability"),
    )
    return rows.withColumn("overall", long(agents.readability([F.col(c) for c in SQL_READ])))


@register(SQL_READABILITY + "SELECT * FROM o")
def readability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readability(spark, sf_dir)


@register(SQL_READABILITY + "SELECT round(avg(overall), 6) AS average, count(*) FILTER (overall > 70) AS good, count(*) FILTER (overall < 50) AS poor, count(*) AS pages FROM o")
def readability_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readability(spark, sf_dir).agg(six(F.avg("overall")).alias("average"), F.count_if(F.col("overall") > 70).alias("good"), F.count_if(F.col("overall") < 50).alias("poor"), F.count(F.lit(1)).alias("pages"))


STATUSES = [200, 200, 201, 301, 404, 500, 200]
SQL_STATUS = "[" + ", ".join(map(str, STATUSES)) + "][(page % 7 + 1)::INT]"


def _status(page: Column) -> Column:
    return F.array(*[F.lit(s) for s in STATUSES])[(page % 7).cast("int")]


@register(f"""WITH {SQL_PAGES}, q AS (SELECT *, {SQL_STATUS} AS status FROM p)
SELECT page, least(100, greatest(0, CASE WHEN status IN (200, 201) THEN 30 WHEN status BETWEEN 300 AND 399 THEN 20 WHEN status BETWEEN 400 AND 499 THEN 15 ELSE 0 END + {sql_points([('has_hsts', 15), ('has_csp', 15), ('has_frame_options', 5), ('has_content_type_options', 5), ('has_schema_org', 30), ('has_llms_txt', 10), ('has_ai_txt', 5), ('has_restrictions', -5)])} + least(api_score, 10)))::DOUBLE AS score FROM q""")
def backend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pages(spark, sf_dir)
    return df.select("page", agents.backend_score(_columns(df), _status(F.col("page")), F.col("api_score")).alias("score"))


@register(f"WITH {SQL_PAGES} SELECT {SQL_STATUS}::BIGINT AS status_code, count(*) AS n, min(CASE {SQL_STATUS} WHEN 200 THEN 'OK' WHEN 201 THEN 'Created' WHEN 301 THEN 'Moved Permanently' WHEN 404 THEN 'Not Found' WHEN 500 THEN 'Internal Server Error' END) AS status_text, ({SQL_STATUS} // 100)::BIGINT AS class FROM p GROUP BY 1, 4")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.operators.rollups import status_histogram as count

    names = F.create_map(*[F.lit(x) for pair in markup.STATUS_TEXTS.items() for x in pair])
    rows = count(_pages(spark, sf_dir).select(_status(F.col("page")).alias("status_code")))
    return rows.select(long(F.col("status_code")).alias("status_code"), "n", F.coalesce(F.try_element_at(names, F.col("status_code")), F.lit("Unknown")).alias("status_text"), F.floor(F.col("status_code") / 100).alias("class"))


@register(f"WITH {SQL_PAGES} SELECT page, {SQL_STATUS}::BIGINT AS status_code FROM p WHERE {SQL_STATUS} <> 200")
def non_200_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page", long(_status(F.col("page"))).alias("status_code")).filter("status_code <> 200")


@register(f"""WITH {SQL_PAGES} SELECT page, greatest(0, 100 - CASE WHEN n_h1 = 0 THEN 30 WHEN n_h1 > 1 THEN 15 ELSE 0 END - CASE WHEN n_h2 > 0 AND n_h1 = 0 THEN 20 ELSE 0 END - CASE WHEN n_h3 > 0 AND n_h2 = 0 THEN 15 ELSE 0 END
 - CASE WHEN n_h4 > 0 AND n_h3 = 0 THEN 10 ELSE 0 END - CASE WHEN n_h2 > 10 THEN 10 ELSE 0 END - CASE WHEN n_h3 > 15 THEN 10 ELSE 0 END)::DOUBLE AS score,
 coalesce(nullif(concat_ws(', ', CASE WHEN n_h1 = 0 THEN 'H1' END, CASE WHEN n_h2 = 0 AND n_h3 + n_h4 + n_h5 + n_h6 > 0 THEN 'H2' END, CASE WHEN n_h3 = 0 AND n_h4 + n_h5 + n_h6 > 0 THEN 'H3' END,
 CASE WHEN n_h4 = 0 AND n_h5 + n_h6 > 0 THEN 'H4' END, CASE WHEN n_h5 = 0 AND n_h6 > 0 THEN 'H5' END), ''), 'None') AS missing FROM p""")
def heading_structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.functions.markup import missing_heading_levels

    h = [F.col(f"n_h{k}") for k in range(1, 7)]
    return _pages(spark, sf_dir).select("page", content.heading_structure(*h[:4]).alias("score"), missing_heading_levels(h).alias("missing"))


AS_OF = "2024-02-15 12:00:00"
SQL_DAYS = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400000000.0"


@register(f"""WITH d AS (SELECT o_orderkey AS page, {SQL_DAYS} AS d, o_orderkey % 13 AS k FROM orders)
SELECT page, round(CASE WHEN k = 0 THEN 0 WHEN d <= 7 THEN 100 WHEN d <= 30 THEN 90 WHEN d <= 90 THEN 75 WHEN d <= 180 THEN 60 WHEN d <= 365 THEN 40 ELSE greatest(0, 30 - (d - 365) / 100) END::DOUBLE, 6) AS score,
 CASE WHEN k <> 0 THEN CASE WHEN floor(d) <= 7 THEN 'Very Fresh' WHEN floor(d) <= 30 THEN 'Fresh' WHEN floor(d) <= 90 THEN 'Moderately Fresh' ELSE 'Stale' END
  ELSE CASE WHEN floor(d / 40) <= 7 THEN 'Potentially Fresh' WHEN floor(d / 40) <= 30 THEN 'Potentially Moderately Fresh' ELSE 'Potentially Stale' END END AS status FROM d""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: modified on the order's date (unknown for every 13th), crawled at a fortieth of that age."""
    as_of = F.lit(AS_OF).cast("timestamp")
    made = F.col("o_orderdate").cast("timestamp")
    modified = F.when(F.col("o_orderkey") % 13 != 0, made)
    crawled = F.timestamp_micros(F.unix_micros(as_of) - ((F.unix_micros(as_of) - F.unix_micros(made)) / 40).cast("bigint"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), six(content.freshness_score(modified, as_of)).alias("score"), content.freshness_status(modified, crawled, as_of).alias("status"))


@register(f"""WITH {SQL_PAGES}, m AS (SELECT page, least(100, least(30, 5 * n_tables) + least(40, 10 * n_inputs) + least(30, 5 * n_fields)) AS media, n_h2 * 8.0 AS h, api_score * 1.5 AS f FROM p)
SELECT page, media::DOUBLE AS media, round(least(100, greatest(0, 0.3 * h + 0.25 * f + 15 + 15 + 0.15 * media))::DOUBLE, 6) AS score FROM m""")
def content_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = content.media_richness(F.col("n_tables"), F.col("n_inputs"), F.col("n_fields"))
    return _pages(spark, sf_dir).select("page", rich.alias("media"), six(content.content_quality(F.col("n_h2") * 8.0, F.col("api_score") * 1.5, rich)).alias("score"))


HEADERS = ["strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy", "x-xss-protection"]
POLICIES = ["", "default-src 'self'", "default-src 'self'; script-src 'unsafe-inline' 'unsafe-eval'; style-src x; img-src *", "default-src a; script-src b; style-src c; img-src d; connect-src e; form-action f; frame-ancestors g"]
COOKIES = ["a=1; Secure; HttpOnly; SameSite=Lax; Max-Age=3", "b=2; HttpOnly;", "c=3; Secure; Expires=x"]


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    policy = F.array(*[F.lit(p) for p in POLICIES])[(k % 4).cast("int")]
    values = {h: F.when((k * (i + 3)) % 5 < 3, "on").otherwise("") for i, h in enumerate(HEADERS)}
    values["content-security-policy"] = policy
    values["x-xss-protection"] = F.when(k % 3 == 0, "1; mode=block").when(k % 3 == 1, "1").otherwise("")
    headers = F.create_map(*[x for h, v in values.items() for x in (F.lit(h), v)])
    cookies = F.slice(F.array(*[F.lit(c) for c in COOKIES]), 1, (k % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("page"), headers.alias("headers"), cookies.alias("cookies"), (k % 2 == 0).alias("https"), (k % 13).alias("risky"))


SQL_HEADERS = (
    "h AS (SELECT c_custkey AS page, "
    + ", ".join(f"(c_custkey * {i + 3}) % 5 < 3 AS h{i}" for i in range(len(HEADERS)))
    + ", [" + ", ".join("'" + p.replace("'", "''") + "'" for p in POLICIES) + "][(c_custkey % 4 + 1)::INT] AS csp, c_custkey % 3 AS x, c_custkey % 4 AS n, c_custkey % 2 = 0 AS https, c_custkey % 13 AS risky FROM customer), "
    + "s AS (SELECT page, https, risky, (CASE WHEN h0 THEN 20 ELSE 0 END + CASE WHEN csp <> '' THEN 20 ELSE 0 END + CASE WHEN h2 THEN 15 ELSE 0 END + CASE WHEN h3 THEN 15 ELSE 0 END + CASE WHEN h4 THEN 15 ELSE 0 END + CASE WHEN h5 THEN 15 ELSE 0 END) AS headers, "
    + "[0, 100, 100 - 45, 100 - 45 - 35][(n + 1)::INT] AS cookies, "
    + "CASE WHEN csp = '' THEN 0 ELSE greatest(0, 100 - (" + " + ".join(f"CASE WHEN contains(csp, '{d}') THEN 0 ELSE 14 END" for d in ("default-src", "script-src", "style-src", "img-src", "connect-src", "form-action", "frame-ancestors")) + ") - CASE WHEN contains(csp, '''unsafe-inline''') THEN 20 ELSE 0 END - CASE WHEN contains(csp, '''unsafe-eval''') THEN 20 ELSE 0 END) END AS csp, "
    + "greatest(0, 100 - CASE x WHEN 0 THEN 0 WHEN 1 THEN 25 ELSE 50 END - CASE WHEN csp = '' THEN 25 ELSE CASE WHEN contains(csp, 'script-src') THEN 0 ELSE 15 END + CASE WHEN contains(csp, '''unsafe-inline''') THEN 15 ELSE 0 END END) AS xss FROM h)"
)


@register(f"WITH {SQL_HEADERS} SELECT page, headers::BIGINT AS headers, cookies::BIGINT AS cookies, csp::BIGINT AS csp, xss::BIGINT AS xss, round((CASE WHEN https THEN 30 ELSE 0 END + 0.2 * headers + 0.15 * cookies + 0.15 * csp + 0.1 * xss + 0.1 * greatest(0, 100 - 10 * risky))::DOUBLE, 6) AS overall FROM s")
def security_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, c = F.col("headers"), F.col("cookies")
    rows = _headers(spark, sf_dir).select("page", "https", "risky", security.header_score(h).alias("h"), security.cookie_score(c).alias("c"), security.csp_score(h).alias("p"), security.xss_score(h).alias("x"))
    overall = security.overall(F.col("https"), F.col("h"), F.col("c"), F.col("p"), F.col("x"), F.col("risky"))
    return rows.select("page", long(F.col("h")).alias("headers"), long(F.col("c")).alias("cookies"), long(F.col("p")).alias("csp"), long(F.col("x")).alias("xss"), six(overall).alias("overall"))


@register("""WITH d AS (SELECT o_orderkey AS page, floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01 00:00:00')) / 86400000000.0) AS d FROM orders)
SELECT CASE WHEN d < 0 THEN 'Expired' WHEN d < 30 THEN 'Expiring soon' ELSE 'Valid' END AS status, count(*) AS n FROM d GROUP BY 1""")
def certificate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = security.certificate_status(F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, greatest(0, 100 - CASE WHEN l_linenumber % 3 = 0 THEN 30 ELSE 0 END - CASE WHEN l_extendedprice * 5 > 200000 THEN 20 WHEN l_extendedprice * 5 > 100000 THEN 10 ELSE 0 END
 - CASE WHEN l_quantity < 10 OR l_partkey % 9 = 0 THEN 15 ELSE 0 END - CASE WHEN l_returnflag <> 'R' AND (l_quantity >= 10 AND l_quantity * 40 > 800 OR l_partkey % 9 * 200 > 800) THEN 15 ELSE 0 END - CASE WHEN l_linestatus = 'O' THEN 10 ELSE 0 END)::BIGINT AS score,
 CASE WHEN l_extendedprice * 5 > 200000 THEN 'Low' WHEN l_extendedprice * 5 > 100000 THEN 'Medium' ELSE 'High' END AS optimization,
 CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE least(100, 5 * len(l_returnflag || l_linestatus || l_partkey)) END::BIGINT AS alt_score FROM lineitem""")
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as images: size from price, width from quantity, height from the part, the rest from flags."""
    height = F.col("l_partkey") % 9 * 200
    size, width = F.col("l_extendedprice") * 5, F.when(F.col("l_quantity") >= 10, F.col("l_quantity") * 40)
    alt = F.when(F.col("l_linenumber") % 3 != 0, F.concat("l_returnflag", "l_linestatus", "l_partkey"))
    score = media.image_score(alt, size, width, height, F.when(F.col("l_returnflag") == "R", "x"), F.when(F.col("l_linestatus") != "O", "lazy"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", long(F.col("l_linenumber")).alias("l_linenumber"), long(score).alias("score"), media.image_optimization(size).alias("optimization"), long(media.alt_text_score(alt)).alias("alt_score"))


@register("""WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '/i/a.JPG' WHEN 1 THEN '/i/b.png?v=1' WHEN 2 THEN '' WHEN 3 THEN '/i/c.txt' WHEN 4 THEN '/x/d.webp' ELSE '/noext' END AS src FROM part)
SELECT p_partkey, CASE WHEN src = '' THEN 'unknown' WHEN f IN ('jpg','jpeg','png','gif','webp','svg') THEN f ELSE 'img unknown' END AS format,
 CASE WHEN e = '' THEN 'text/html' WHEN e IN ('jpg') THEN 'image/jpeg' WHEN e = 'png' THEN 'image/png' WHEN e = 'txt' THEN 'text/plain' ELSE 'unknown' END AS content_type
FROM (SELECT p_partkey, src, lower(string_split(string_split(src, '?')[1], '.')[-1]) AS f, lower(regexp_extract(string_split(src, '?')[1], '\\.([A-Za-z0-9]+)$', 1)) AS e FROM s)""")
def media_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    src = F.when(k == 0, "/i/a.JPG").when(k == 1, "/i/b.png?v=1").when(k == 2, "").when(k == 3, "/i/c.txt").when(k == 4, "/x/d.webp").otherwise("/noext")
    return table(spark, sf_dir, "part").select("p_partkey", urls.image_format(src).alias("format"), urls.content_type(F.concat(F.lit("https://x.org"), src), F.lit(200), F.lit("")).alias("content_type"))


@register("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 403 WHEN 2 THEN 200 WHEN 3 THEN 0 ELSE 404 END AS s, event_id % 7 AS k FROM events)
SELECT CASE WHEN s IN (403, 503) AND k = 0 THEN 'challenge' WHEN s IN (401, 403, 429) THEN 'blocked' WHEN k = 1 THEN 'network' WHEN s >= 400 OR k = 0 THEN 'other' END AS kind, count(*) AS n FROM e GROUP BY 1""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("event_id") % 5, F.col("event_id") % 7
    status = F.when(s == 0, 503).when(s == 1, 403).when(s == 2, 200).when(s == 3, 0).otherwise(404)
    kind = urls.error_class(status, F.when(k == 1, "ETIMEDOUT").otherwise(""), F.when(k == 0, "Just a moment...").otherwise(""))
    return table(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT event_id, round(CASE WHEN o = 0 THEN CASE WHEN v = 0 THEN 0 ELSE 100 END ELSE (v - o) / nullif(o, 0) * 100 END::DOUBLE, 6) AS percent, floor(v * 10 - 300 + 0.5)::BIGINT AS rounded,
 CASE WHEN v <= 20 THEN 'pass' WHEN v <= 60 THEN 'warn' ELSE 'fail' END AS lower_better, CASE WHEN v >= 60 THEN 'pass' WHEN v >= 20 THEN 'warn' ELSE 'fail' END AS higher_better
FROM (SELECT event_id, value AS v, CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END AS o FROM events)""")
def changes_and_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, o = F.col("value"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("user_id"))
    return table(spark, sf_dir, "events").select(
        "event_id", six(numbers.percent_change(o, v)).alias("percent"), numbers.half_up(v * 10 - 300).alias("rounded"),
        numbers.pass_warn_fail(v, F.lit(20), F.lit(60), F.lit(False)).alias("lower_better"), numbers.pass_warn_fail(v, F.lit(60), F.lit(20), F.lit(True)).alias("higher_better"),
    )


@register("SELECT event_id, CASE WHEN v > 20 THEN 'Needs Work' WHEN v > 5 THEN 'Fair' ELSE 'Good' END AS label, greatest(0.0, 100 - 5 * (event_id % 7) - 2 * (event_id % 11) - 0.5 * (event_id % 3))::DOUBLE AS score FROM (SELECT event_id, value AS v FROM events)")
def accessibility_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k, accessibility.overview(F.col("value")).alias("label"), accessibility.site_score(k % 7, k % 11, k % 3).alias("score"))


@register(f"WITH {SQL_PAGES}, s AS (SELECT page, {SQL_SERVED}::DOUBLE AS served FROM p), r AS (SELECT l_orderkey AS page, count(*) AS resources, max(l_linenumber)::BIGINT AS depth FROM lineitem GROUP BY 1) SELECT page, served, resources, depth FROM s JOIN r USING (page) WHERE served < 50 AND resources > 3")
def reports_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports joined by page and filtered on both: poorly served pages with many resources."""
    df = _pages(spark, sf_dir)
    scores = df.select("page", _served(_columns(df)).cast("double").alias("served"))
    resources = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count(F.lit(1)).alias("resources"), F.max("l_linenumber").cast("bigint").alias("depth"))
    return rollups.join_reports(scores, resources, "page").filter("served < 50 AND resources > 3")

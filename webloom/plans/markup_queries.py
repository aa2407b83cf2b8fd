"""Queries of the structural pass over stored pages, with elements added by page number that the sample pages lack; the second engine
counts them in the same markup by regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.extract import page_features
from webloom.plans.page_queries import long, six
from webloom.plans.registry import register
from webloom.sources.tables import table

#: Elements for the head and for the end of a page, each with the condition on its number that adds it.
HEAD = [
    ('<meta name="viewport" content="width=device-width">', "k % 2 = 0"), ('<meta name="Description" content="About page">', "k % 3 = 0"), ('<meta name="robots" content="noindex, follow">', "k % 5 = 0"), ('<meta name="robots" content="all">', "k % 5 = 1"), ('<meta property="og:title" content="t">', "k % 4 = 0"), ('<meta property="og:type" content="x">', "k % 6 = 0"),
    ('<meta name="twitter:card" content="x">', "k % 7 = 0"), ('<meta name="llms-txt" content="/x">', "k % 11 = 0"), ('<link rel="canonical" href="https://c.com/p">', "k % 3 = 1"), ('<link rel="alternate" hreflang="de" href="/de">', "k % 4 = 1"), ('<link rel="alternate" hreflang="x-default" href="/x">', "k % 8 = 1"), ('<link rel="stylesheet" href="/s.css">', "k % 2 = 1"),
    ('<link rel="preload" as="font" href="/f.woff2">', "k % 5 = 2"), ('<link rel="prefetch" as="script" href="/next.js">', "k % 5 = 3"), ('<link rel="preconnect" href="https://cdn.com/">', "k % 6 = 3"), ("<style>@font-face { font-family: x; src: url(/x.woff) } i { background: url(/no.png) }</style>", "k % 7 = 3"),
    ('<script type="application/ld+json">{"@context":"https://schema.org","@type":["Shop","Thing"]}</script>', "k % 3 = 2"), ('<script type="application/ld+json">{"@type":"Other"}</script>', "k % 4 = 2"), ('<script type="application/ld+json">not json</script>', "k % 9 = 2"), ('<script src="/a/graphql.js"></script>', "k % 6 = 1"), ('<script src="/api/x.js"></script>', "k % 8 = 3"),
    ('<meta property="llms:txt" content="/y">', "k % 13 = 2"), ('<meta name="x-api-key" content="z">', "k % 9 = 4"), ('<a href="/robots.txt">r</a>', "k % 8 = 6"), ('<script type="application/ld+json">{"@context":"https://schema.org","name":"no type"}</script>', "k % 5 = 4"),
    ('<script type="application/ld+json">{"@context":["https://schema.org/"],"@type":"Listed"}</script>', "k % 6 = 5"), ('<link rel="alternate" type="application/json" href="/swagger.json">', "k % 11 = 5"), ('<script src="https://challenges.cloudflare.com/turnstile.js"></script>', "k % 31 = 5"),
    ('<script src="https://hcaptcha.com/1.js"></script>', "k % 13 = 1"), ('<script src="https://www.google.com/recaptcha/api.js"></script>', "k % 17 = 1"),
]
TAIL = [
    ('<img src="a.png">', "k % 2 = 0"), ('<img src="b.png" alt="">', "k % 3 = 0"), ('<img src="c.png" alt="a cat" width="5">', "k % 4 > 0"), ('<img src="d.png" alt="' + "long " * 25 + '">', "k % 5 = 0"), ('<a href="/in"></a>', "k % 3 = 1"), ('<a href="https://b.org/x" rel="nofollow ugc">out</a>', "k % 4 = 0"), ('<a href="/more">Read more</a>', "k % 5 = 1"), ('<a href="/llms.txt">l</a>', "k % 7 = 1"),
    ('<a href="/ai.txt">l</a>', "k % 9 = 1"), ('<a href="/Docs/v1">d</a>', "k % 10 = 1"), ('<a href="/docs/api">d</a>', "k % 6 = 2"), ('<a href="/login">in</a>', "k % 4 = 3"), ('<a href="/SignOut">out</a>', "k % 6 = 5"), ('<a href="/my/profile">me</a>', "k % 8 = 5"), ('<video src="v.mp4"></video>', "k % 5 = 4"), ('<iframe src="https://i.com/"></iframe>', "k % 6 = 4"), ('<div style="background: url(bg.gif)"></div>', "k % 7 = 4"),
    ('<main><section><article class="x">y</article></section></main>', "k % 2 = 0"), ("<header>h</header>", "k % 3 = 0"), ('<label for="e">E</label>', "k % 2 = 0"), ('<input id="e" name="email" type="email" autocomplete="email" required>', "k % 3 < 2"), ('<input name="odd" aria-label="o">', "k % 4 = 0"), ('<input type="hidden" name="token">', "k % 5 = 0"), ('<select id="city"></select>', "k % 6 = 0"),
    ('<textarea name="note"></textarea>', "k % 7 = 0"), ("<button disabled>b</button>", "k % 3 = 0"), ('<button disabled title="why">b</button>', "k % 4 = 0"), ('<input type="submit">', "k % 5 = 1"), ("<table><caption>c</caption><tr><th>x</th></tr></table>", "k % 4 = 1"), ('<table><tr><th scope="col">x</th><td data-v="1">1</td><td data-price="2">2</td></tr></table>', "k % 5 = 2"), ('<table><tr><td scope="row" data-price="">1</td></tr></table>', "k % 7 = 5"),
    ('<button disabled aria-label="why">b</button>', "k % 8 = 2"), ('<input type="button" disabled>', "k % 9 = 5"), ('<input type="submit" disabled data-disabled-reason="r">', "k % 11 = 2"), ('<a href="/sign-in">i</a>', "k % 7 = 6"), ('<a href="/LOGIN">i</a>', "k % 5 = 0"), ('<form action="/logout"></form>', "k % 10 = 6"), ('<i data-user-email="e"></i>', "k % 13 = 4"), ('<i data-userid="7"></i>', "k % 3 = 0"),
    ('<i data-state="loading"></i>', "k % 8 = 7"), ('<i data-valid="1" data-auth-state="in" data-loading-state="x"></i>', "k % 4 = 0"), ('<i aria-invalid="false"></i>', "k % 3 = 1"), ('<p class="my-field-error">e</p>', "k % 5 = 1"), ('<i data-error-code="7"></i>', "k % 12 = 7"), ('<input name="need" aria-required="true" autocomplete="tel">', "k % 6 = 2"), ('<a href="https://x.org/swagger">s</a>', "k % 14 = 3"),
    ('<object data="pic.svg"></object>', "k % 6 = 1"), ('<embed src="plug.swf">', "k % 5 = 1"), ('<object data="drawn" type="image/svg+xml"></object>', "k % 7 = 2"), ('<picture><source srcset="w1.webp 1x, w2.webp 2x" src="not.png"></picture>', "k % 4 = 3"), ('<audio src="s.mp3"><source srcset="no.mp3"></audio>', "k % 9 = 6"),
    ('<div role="alert">!</div>', "k % 4 = 2"), ('<div aria-live="polite"></div>', "k % 6 < 3"), ('<i aria-invalid="true"></i>', "k % 7 = 2"), ('<i data-state="x" data-agent-visible="true"></i>', "k % 5 = 3"), ('<i data-agent-visible="false"></i>', "k % 8 = 3"), ('<i data-authenticated="1" data-user-id="7"></i>', "k % 9 = 3"), ('<i data-validation-state="ok" data-loading="1"></i>', "k % 6 = 3"), ('<i data-error="x" hidden></i>', "k % 10 = 3"),
    ('<i itemscope style="display: none"></i>', "k % 11 = 3"), ('<div class="g-recaptcha"></div>', "k % 19 = 3"), ("<p>Please verify you are human</p>", "k % 23 = 3"), ('<div class="cf-browser-verification"></div>', "k % 29 = 3"),
]


def _added(elements: list[tuple[str, str]]) -> str:
    return "concat(" + ", ".join(f"CASE WHEN {when} THEN '{html}' ELSE '' END" for html, when in elements) + ")"


#: The markup, as an expression for both engines; the part from the article's end, where elements are added, starts with a mark.
HTML = f"concat(replace(html, '<head>', concat('<head>', {_added(HEAD)})), '<!--end-->', {_added(TAIL)})"
SQL_HTML = f"h AS (SELECT k, url, {HTML} AS html FROM (SELECT page_id AS k, url, html FROM pages))"


def _features(spark: SparkSession, sf_dir: str, wanted: list[str]) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), "url", "html").select("k", "url", F.expr(HTML).alias("html"))
    return page_features(pages, None, ["k"], wanted)


def _tags(name: str, having: str = "true") -> str:
    """SQL of how many start tags of that name there are for which ``having`` (on the tag's text x) holds."""
    return f"len(list_filter(regexp_extract_all(html, '<{name}(?:\\s[^>]*)?>'), lambda x: {having}))"


def _attr(name: str, value: str = "") -> str:
    """SQL of how many tags have an attribute, or one with a value that matches."""
    end = f'="{value}"' if value else "(?:=|[\\s>])"
    return f"len(regexp_extract_all(html, '<[a-z][^>]*\\s{name}{end}'))"


def _longs(df: DataFrame, names: list[str], key: str = "k") -> DataFrame:
    return df.select(F.col(key).alias("page_id"), *[long(F.col(n)).alias(n) for n in names])


def _sql(fields: dict[str, str]) -> str:
    return f"WITH {SQL_HTML} SELECT k AS page_id, " + ", ".join(f"{v} AS {c}" for c, v in fields.items()) + " FROM h"


_ANCHORS = "regexp_extract_all(html, '<a href=\"[^\"]*\"[^>]*>[^<]*</a>')"

MEDIA = {
    "n_images": _tags("img"), "n_images_no_alt_attr": _tags("img", "NOT contains(x, 'alt=')"), "n_images_empty_alt": _tags("img", "contains(x, 'alt=\"\"')"), "n_images_long_alt": _tags("img", "length(regexp_extract(x, 'alt=\"([^\"]*)\"', 1)) > 100"),
    "n_links": f"len({_ANCHORS})", "n_internal": f"len(list_filter({_ANCHORS}, lambda x: contains(x, 'href=\"/')))", "n_external": f"len(list_filter({_ANCHORS}, lambda x: NOT contains(x, 'href=\"/')))", "n_nofollow": f"len(list_filter({_ANCHORS}, lambda x: contains(x, 'nofollow')))",
    "n_empty_anchor": f"len(list_filter({_ANCHORS}, lambda x: contains(x, '></a>')))", "n_generic_anchor": f"len(list_filter({_ANCHORS}, lambda x: regexp_matches(lower(x), '>(click here|read more|learn more)<')))",
}


@register(_sql(MEDIA))
def page_images_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and link counters of all pages."""
    found = _features(spark, sf_dir, ["images", "links", *[c for c in MEDIA if c not in ("n_images", "n_links")]])
    return _longs(found.withColumns({"n_images": F.size("images"), "n_links": F.size("links")}), list(MEDIA))


HEAD_FIELDS = {
    "has_viewport": "contains(html, 'name=\"viewport\"')", "meta_description": "regexp_extract(html, 'name=\"Description\" content=\"([^\"]*)\"', 1)", "canonical": "nullif(regexp_extract(html, 'rel=\"canonical\" href=\"([^\"]*)\"', 1), '')", "html_lang": "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)", "robots_meta": "regexp_extract(html, 'name=\"robots\" content=\"([^\"]*)\"', 1)",
    "has_restrictions": "regexp_matches(regexp_extract(html, 'name=\"robots\" content=\"([^\"]*)\"', 1), 'noindex|nofollow|noarchive')", "hreflangs": "array_to_string(regexp_extract_all(html, 'hreflang=\"([^\"]*)\"', 1), ',')", "n_og": "len(regexp_extract_all(html, 'property=\"og:'))", "n_twitter": "len(regexp_extract_all(html, 'name=\"twitter:'))", "n_json_ld": "len(regexp_extract_all(html, 'ld.json'))",
    "schema_types": "concat_ws(',', CASE WHEN contains(html, '\"Shop\"') THEN 'Shop,Thing' END, CASE WHEN contains(html, '\"Other\"') THEN 'Other' END, CASE WHEN contains(html, '\"Listed\"') THEN 'Listed' END)", "has_schema_org": "contains(html, '\"Shop\"')",
    "is_noindex": "contains(html, 'content=\"noindex')", "is_nofollow": "false", "is_noarchive": "false", "has_robots_txt": "contains(html, '/robots.txt')", "has_llms_meta": "contains(html, 'llms-txt') OR contains(html, 'llms:txt')", "has_llms_link": "contains(html, '/llms.txt')", "has_api_meta": "contains(html, 'x-api-key')", "n_microdata": _attr("itemscope"),
}


@register(_sql(HEAD_FIELDS))
def page_head_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language versions, canonical address, robots, social and structured data of all pages."""
    found = _features(spark, sf_dir, ["has_viewport", "meta_description", "canonical", "html_lang", "robots_meta", "has_restrictions", "hreflangs", "og", "twitter", "json_ld", "schema_types", "has_schema_org", "n_microdata", "is_noindex", "is_nofollow", "is_noarchive", "has_robots_txt", "has_llms_meta", "has_llms_link", "has_api_meta"])
    counted = found.withColumns({"n_og": long(F.size("og")), "n_twitter": long(F.size("twitter")), "n_json_ld": long(F.size("json_ld")), "n_microdata": long(F.col("n_microdata")), "schema_types": F.array_join("schema_types", ","), "hreflangs": F.array_join("hreflangs", ",")})
    return counted.select(F.col("k").alias("page_id"), *HEAD_FIELDS)


#: Resources of a page by type: (type, address as written, condition).
SQL_RESOURCE_ROWS = [("css", "/s.css"), ("font", "/f.woff2"), ("javascript", "/next.js"), ("other", "https://cdn.com/"), ("font", "/x.woff"), ("javascript", "/a/graphql.js"), ("javascript", "/api/x.js"), ("javascript", "https://hcaptcha.com/1.js"), ("javascript", "https://www.google.com/recaptcha/api.js"), ("image", "a.png"), ("image", "b.png"), ("image", "c.png"), ("image", "d.png"), ("video", "v.mp4"), ("iframe", "https://i.com/"), ("image", "bg.gif"), ("javascript", "https://challenges.cloudflare.com/turnstile.js"), ("image", "pic.svg"), ("image", "drawn"), ("audio", "s.mp3")]
#: What of a srcset is a resource.
SQL_RESOURCE_ROWS += [("image", "w1.webp 1x, w2.webp 2x")] * 2


@register(f"WITH {SQL_HTML} SELECT k AS page_id, type, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT k, '{t}' AS type FROM h WHERE regexp_matches(html, '[\"(]{u}[\")]')" for t, u in SQL_RESOURCE_ROWS) + ") GROUP BY 1, 2")
def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of all pages by type: scripts, style sheets, images, fonts, hints, frames, media and backgrounds."""
    found = _features(spark, sf_dir, ["resources"])
    return found.select("k", F.inline("resources")).groupBy(F.col("k").alias("page_id"), "type").agg(F.count(F.lit(1)).alias("n"))


_INPUTS = "regexp_extract_all(html, '<(?:input|select|textarea)(?:\\s[^>]*)?>')"
_FIELDS = f"list_filter({_INPUTS}, lambda x: NOT regexp_matches(x, 'type=\"(hidden|submit|button)\"'))"
_NAMED = f"len(list_filter({_INPUTS}, lambda x: regexp_matches(x, '(name|id)=\"(email|city)\"')))"
_LABELLED = f"len(list_filter({_INPUTS}, lambda x: contains(x, 'aria-label') OR (contains(x, 'id=\"e\"') AND contains(html, 'for=\"e\"'))))"
_COMPLETED = f"len(list_filter({_FIELDS}, lambda x: contains(x, 'autocomplete')))"
_BUTTONS = "regexp_extract_all(html, '<button[^>]*>|<input type=\"(?:submit|button)\"[^>]*>')"
_DISABLED = f"list_filter({_BUTTONS}, lambda x: regexp_matches(x, '\\sdisabled') AND NOT contains(x, '\"button\"'))"
_EXPLAINED = f"len(list_filter({_DISABLED}, lambda x: contains(x, 'title') OR contains(x, 'data-disabled-reason')))"


def _sql_share(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} = 0 THEN 1 ELSE ({part})::DOUBLE / {whole} END, 6)"


FORMS = {
    "n_inputs": f"len({_INPUTS})", "n_standard_names": _NAMED, "n_labelled": _LABELLED, "n_typed": f"len(list_filter({_INPUTS}, lambda x: contains(x, 'type=')))", "n_required": f"len(list_filter({_INPUTS}, lambda x: contains(x, 'required')))", "autocomplete_values": "concat_ws(',', CASE WHEN contains(html, 'autocomplete=\"email\"') THEN 'email' END, CASE WHEN contains(html, 'autocomplete=\"tel\"') THEN 'tel' END)", "n_fields": f"len({_FIELDS})", "n_autocomplete": _COMPLETED,
    "n_buttons": f"len({_BUTTONS})", "n_disabled": f"len({_DISABLED})", "n_explained": _EXPLAINED,
    "name_ratio": _sql_share(_NAMED, f"len({_INPUTS})"), "label_ratio": _sql_share(_LABELLED, f"len({_INPUTS})"), "autocomplete_ratio": _sql_share(_COMPLETED, f"len({_FIELDS})"), "explained_ratio": _sql_share(_EXPLAINED, f"len({_DISABLED})"), "good_autocomplete": f"len({_FIELDS}) = 0 OR {_COMPLETED} >= 0.7 * len({_FIELDS})",
}


@register(_sql(FORMS))
def page_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields, labels, completion hints and buttons of all pages."""
    found = _features(spark, sf_dir, list(FORMS))
    return found.select(F.col("k").alias("page_id"), *[six(F.col(c)).alias(c) if c.endswith("ratio") else F.array_join(c, ",").alias(c) if c.endswith("values") else F.col(c) if c.startswith("good") else long(F.col(c)).alias(c) for c in FORMS])


_CELLS = _tags("td")
SIGNALS = {
    "n_main": _tags("main"), "n_nav": _tags("nav"), "n_header": _tags("header"), "n_section": _tags("section"), "has_llms_txt": "contains(html, 'llms.txt') OR contains(html, 'llms-txt') OR contains(html, 'llms:txt')", "has_ai_txt": "contains(html, 'ai.txt')",
    "captcha_type": "CASE WHEN contains(html, 'recaptcha') THEN 'reCAPTCHA' WHEN contains(html, 'hcaptcha') THEN 'hCaptcha' WHEN contains(html, 'turnstile') THEN 'Turnstile' WHEN contains(html, 'verify you are human') THEN 'Unknown' ELSE 'None' END", "has_bot_protection": "regexp_matches(html, 'captcha|verify you are human|cf-browser-verification|cloudflare')", "has_recaptcha": "contains(html, 'recaptcha')", "has_hcaptcha": "contains(html, 'hcaptcha')", "has_turnstile": "contains(html, 'turnstile')", "has_challenge": "regexp_matches(html, 'cf-browser-verification|cloudflare')",
    "api_score": "25 * regexp_matches(html, '<a href=\"[^\"]*/(api|docs|swagger)')::INT + 25 * contains(html, '/swagger.json')::INT + 15 * contains(html, 'src=\"/api/')::INT + 15 * contains(html, 'graphql')::INT", "n_api_links": "len(regexp_extract_all(html, '<a href=\"[^\"]*/(?:api|docs|swagger)'))", "has_openapi": "contains(html, '/swagger.json')", "n_state": _attr("data-state"), "n_state_elements": "len(list_filter(regexp_extract_all(html, '<i [^>]*>'), lambda x: regexp_matches(x, '\\sdata-(state|authenticated|validation-state|error-code|loading)=')))", "has_state": "contains(html, 'data-state')", "has_auth_state": "contains(html, 'data-authenticated')", "has_user_id": "contains(html, 'data-user-id') OR contains(html, 'data-user-email')", "has_validation": "contains(html, 'data-validation-state')",
    "has_error_state": "contains(html, 'data-error-code')", "has_loading": "contains(html, 'data-loading=') OR contains(html, 'data-state=\"loading\"')", "n_agent_elements": _attr("data-agent-visible"), "n_alerts": "len(regexp_extract_all(html, 'role=\"alert\"'))", "n_live": _attr("aria-live"), "n_invalid": _attr("aria-invalid", "true"), "n_field_errors": "len(regexp_extract_all(html, 'class=\"[^\"]*error'))", "n_agent_visible": _attr("data-agent-visible", "true"), "n_agent_hidden": _attr("data-agent-visible", "false"), "has_alert": "contains(html, 'role=\"alert\"')", "has_live": "contains(html, 'aria-live')", "has_persistent_errors": "contains(html, 'role=\"alert\"') AND contains(html, 'aria-live')",
    "has_invalid": "contains(html, 'aria-invalid=\"true\"')", "n_tables": _tags("table"), "tables_with_caption": _tags("caption"), "tables_with_scope": f"CASE WHEN contains(html, 'scope=\"col\"') THEN {_tags('table')} ELSE 0 END", "machine_readable_ratio": f"round(CASE WHEN {_CELLS} = 0 THEN 0 ELSE {_tags('td', 'regexp_matches(x, $$data-price=.[0-9]$$)')}::DOUBLE / {_CELLS} END, 6)",
    "hidden_elements": "(contains(html, '\"x\" hidden'))::INT + (contains(html, 'display: none'))::INT", "has_login": "contains(html, '/login') OR contains(html, '/sign-in')", "has_logout": "contains(html, '/logout')", "has_account": "contains(html, '/my/profile')",
}


@register(_sql(SIGNALS))
def page_agent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What programs that read all pages can make out: landmarks, files, protection, interfaces, states, errors, tables, accounts."""
    plain = [c for c in SIGNALS if c not in ("n_main", "n_nav", "n_header", "n_section")]
    found = _features(spark, sf_dir, ["tag_counts", *plain])
    found = found.withColumns({f"n_{t}": F.coalesce(F.try_element_at("tag_counts", F.lit(t)), F.lit(0)) for t in ("main", "nav", "header", "section")})
    kinds = dict(found.dtypes)
    return found.select(F.col("k").alias("page_id"), *[long(F.col(c)).alias(c) if kinds[c] == "int" else six(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in SIGNALS])

"""A whole audit: from stored pages to all reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from webloom.config import AuditConfig
from webloom.functions import agents, content, markup, media, security, seo, urls
from webloom.operators import history, keywords, links, llms_txt, patterns, robots, rollups, technology
from webloom.operators.extract import page_features
from webloom.functions.markup import STATUS_TEXTS
from webloom.functions.numbers import half_up
from webloom.sinks import reports
from webloom.sources.run_store import RunStore, run_key
from webloom.storage import materialize

SPECIAL = r"/(robots|llms)\.txt$"


def audit(pages: DataFrame, config: AuditConfig, sitemap: DataFrame | None = None, issues: DataFrame | None = None, performance: DataFrame | None = None) -> dict[str, DataFrame]:
    """Report tables by name, for pages of (url, html, status_code, headers, last_modified, last_crawled).

    Robots and language filters, the limit and the split-off of robots.txt and llms.txt come before the structural pass, which is the
    only Python in the plan; its result is stored once, and all reports read it from there. Pages that failed (status other than 200, no markup, or markup that the pass fails on) are rows of failed_urls with the reason and the number of attempts, and are not scored. Issues (page_url,
    code, type, message) and timings (columns of PERFORMANCE) are joined from the left, so a page without them keeps its row."""
    spark = pages.sparkSession
    files = pages.filter(F.lower(urls.path(F.col("url"))).rlike(SPECIAL)).select("url", F.col("html").alias("content"))
    rest = pages.filter(~F.lower(urls.path(F.col("url"))).rlike(SPECIAL))
    if not config.include_all_languages:
        rest = rest.filter(urls.language_allowed(F.col("url"), letters_only=False, ignore_case=False))
    robot_files, llms_files = files.filter(F.endswith(F.lower("url"), F.lit("robots.txt"))), files.filter(F.endswith(F.lower("url"), F.lit("llms.txt")))
    if config.respect_robots:
        rules = robots.parse(robot_files).withColumn("host", urls.host(F.col("url"))).select("host", "kind", "user_agent", "value")
        keyed = rest.withColumn("host", urls.host(F.col("url")))
        rest = robots.allowed(keyed, rules, config.user_agent, site="host").filter("allowed").drop("allowed", "pattern", "host")
    if config.limit > 0:
        rest = rest.orderBy("url").limit(config.limit)
    good = rest.filter((F.col("status_code") == 200) & (F.coalesce(F.col("html"), F.lit("")) != ""))
    texts = F.create_map(*[F.lit(x) for pair in STATUS_TEXTS.items() for x in pair])
    status = rest.select("url", "status_code", F.coalesce(F.try_element_at(texts, F.col("status_code")), F.lit("Unknown")).alias("status_text"), F.col("last_crawled").alias("ts"))
    as_of = F.to_timestamp(F.lit(config.as_of)) if config.as_of else F.coalesce(F.col("last_crawled"), F.current_timestamp())
    h = F.col("headers")
    seen = Observation("pages")  # counted while the pass runs, without another scan
    passed = page_features(good, config.base_url or None, ["url", "status_code", "headers", "last_modified", "last_crawled"])
    f = materialize(passed.observe(seen, F.count(F.lit(1)).alias("pages"), F.count("error").alias("failed")), "features")
    tries = F.coalesce(F.col("attempts").cast("int"), F.lit(1)) if "attempts" in pages.columns else F.lit(1)
    wrong = F.when(F.col("status_code") != 200, F.concat(F.lit("status "), F.col("status_code").cast("string"))).when(F.col("status_code").isNull(), "no answer").otherwise("no markup")
    failed = rest.join(good.select("url").distinct(), "url", "left_anti").select("url", "status_code", wrong.alias("reason"), tries.alias("attempts"))
    failed = failed.unionByName(f.filter("error is not null").select("url", "status_code", F.col("error").alias("reason"), F.lit(1).alias("attempts")))
    counts, f = seen.get, f.filter("error is null")
    robots_quality, llms_quality = robots.quality(robot_files).withColumn("site", urls.host(F.col("url"))), llms_txt.quality(llms_files).withColumn("site", urls.host(F.col("url")))
    # a site's own llms.txt counts for all its pages, its robots.txt too
    site_files = llms_files.groupBy(urls.host(F.col("url")).alias("site")).agg(F.lit(True).alias("site_has_llms")).join(robots_quality.groupBy("site").agg(F.max("score").alias("robots_score")), "site", "full")
    f = f.withColumn("site", urls.host(F.col("url"))).join(site_files, "site", "left").withColumn("site_has_llms", F.coalesce("site_has_llms", F.lit(False)))
    count = lambda tag: F.coalesce(F.try_element_at("tag_counts", F.lit(tag)), F.lit(0))
    heads = [F.col("heading_counts")[k] for k in range(6)]
    m = {c: F.col(c) for c in f.columns} | {f"has_{t}": count(t) > 0 for t in ("main", "nav", "header", "footer", "article", "section")}
    m |= {f"n_{t}": count(t) for t in ("main", "nav", "header", "footer", "article", "section")} | {f"n_h{k + 1}": v for k, v in enumerate(heads)}
    m |= {"has_hsts": security.header(h, "strict-transport-security").isNotNull(), "has_csp": security.header(h, "content-security-policy").isNotNull(), "has_frame_options": security.header(h, "x-frame-options").isNotNull(), "has_content_type_options": security.header(h, "x-content-type-options").isNotNull()}
    m |= {"n_lists": count("ul") + count("ol"), "description_length": F.char_length("meta_description"), "has_json_ld": F.size("json_ld") > 0, "has_microdata": F.col("n_microdata") > 0, "has_agent_visible": F.col("n_agent_visible") > 0}
    m |= {f"has_og_{t}": (F.coalesce(F.try_element_at("og", F.lit(f"og:{t}")), F.lit("")) != "") for t in ("title", "description", "image", "type")}
    with_alt = F.size(F.filter("images", lambda i: F.coalesce(i["alt"], F.lit("")) != ""))
    keyword = keywords.main_keyword(F.concat_ws(" ", "title", "meta_description", "h1"))
    timings = performance if performance is not None else spark.createDataFrame([], "url string, load_time double, dom_content_loaded double, first_paint double, fcp double, lcp double, tti double, tbt double, cls double")
    f = f.join(timings, "url", "left")
    parts = {
        "title": seo.title(F.char_length("title")), "meta_description": seo.meta_description(m["description_length"]), "url_structure": seo.url_structure(F.col("url")), "h1": seo.h1(F.char_length("h1")),
        "content_length": seo.content_length(F.col("word_count")), "content_quality": seo.content_quality(keyword, F.col("title"), F.col("meta_description"), F.col("h1"), heads[1], heads[2], F.size("images"), F.col("n_external"), F.col("word_count")),
        "internal_linking": seo.internal_linking(F.col("n_internal")), "image_alt": seo.image_alt(with_alt, F.size("images")), "page_speed": seo.page_speed(F.col("load_time")), "mobile": seo.flag(F.col("has_viewport")),
        "security": seo.security_flag(F.col("url")), "structured_data": seo.flag(m["has_json_ld"] | m["has_microdata"]), "social": seo.flag((F.size("og") > 0) | (F.size("twitter") > 0)),
    }
    served = agents.served_score(m)
    read = [agents.structural(m), agents.organization(count("p"), F.col("body_text_length")), agents.metadata(m), agents.extractability(F.col("body_text_length"), F.col("page_size"), F.col("hidden_elements"), F.col("total_elements"))]
    heading, fresh = content.heading_structure(*heads[:4]), content.freshness_score(F.col("last_modified"), as_of)
    rich = content.media_richness(F.size("images"), count("video"), count("form") + count("button"))
    backend = m | {"has_llms_txt": m["has_llms_txt"] | F.col("site_has_llms")}
    link_rows = f.select(F.col("url").alias("source_url"), F.inline("links")).withColumnsRenamed({"url": "target_url"}).filter("target_url is not null")
    internal = links.internal(link_rows)
    image_rows = f.select("url", F.inline("images"))
    numeric = {c: F.expr(f"try_cast({c} as int)") for c in ("width", "height")}
    resources = f.select(F.col("url").alias("page_url"), F.inline("resources"))
    # what is said of a page, once for the three reports that show it
    said = f.withColumn("_said", agents.feedback_details(m, F.lit(config.rendered)))
    essential, top = F.size(F.filter("_said", lambda x: x["essential"])), F.try_element_at("_said", F.lit(1))
    ranks = [F.coalesce(top[c], F.lit("N/A")).alias(c) for c in ("priority", "effort")]
    source, rendered_score = F.lit("rendered" if config.rendered else "served"), agents.rendered_score(served, m)
    whole = lambda ratio: half_up(100 * ratio)
    out = {
        "seo_report": f.select("url", "title", F.char_length("title").alias("title_length"), "meta_description", m["description_length"].alias("description_length"), "h1", heads[0].alias("h1_count"), "word_count", F.size("images").alias("images"), (F.size("images") - with_alt).alias("images_without_alt"), F.col("n_internal").alias("internal_links"), "canonical", "html_lang", "has_viewport", "has_schema_org"),
        "seo_scores": f.select("url", seo.overall(parts).alias("score"), *[v.alias(k) for k, v in parts.items()]),
        "performance_analysis": f.select("url", "load_time", "dom_content_loaded", "first_paint", "fcp", "lcp", F.coalesce("tti", F.col("fcp") + 5000).alias("tti"), "tbt", "cls"),
        "image_optimization": image_rows.select("url", "src", "alt", urls.image_format(F.col("src")).alias("format"), F.lit(None).cast("bigint").alias("size"), "width", "height", media.image_score(F.col("alt"), F.lit(None).cast("bigint"), numeric["width"], numeric["height"], F.col("srcset"), F.col("loading")).alias("score"), media.alt_text_score(F.col("alt")).alias("alt_score"), F.lit(None).cast("string").alias("optimization"), "loading", "srcset"),
        "link_analysis": link_rows.join(status.select(F.col("url").alias("target_url"), F.col("status_code").alias("status")), "target_url", "left").select("source_url", "target_url", "text", urls.link_type(F.col("target_url"), F.col("source_url")).alias("type"), "status", F.lit(0).alias("redirects"), urls.content_type(F.col("target_url"), F.col("status"), F.lit("")).alias("content_type"), urls.in_navigation(F.col("context")).alias("in_navigation"), urls.link_depth(F.col("target_url")).alias("depth"), media.link_score(F.col("text"), F.col("status"), F.lit(0)).alias("score"), "rel"),
        "content_quality": f.select("url", "word_count", heading.alias("heading_score"), fresh.alias("freshness_score"), rich.alias("media_score"), F.lit(100.0).alias("uniqueness"), F.lit(100.0).alias("grammar"), content.content_quality(heading, fresh, rich).alias("score"), content.freshness_status(F.col("last_modified"), F.col("last_crawled"), as_of).alias("freshness")),
        "security_report": f.select("url", (urls.scheme(F.col("url")) == "https").alias("https"), *[m[c].alias(c) for c in ("has_hsts", "has_csp", "has_frame_options", "has_content_type_options")]),
        "all_resources_report": rollups.resource_totals(resources).orderBy(F.desc("uses"), "url"),
        "llm_readability_report": f.select(
            "url", *[v.alias(n) for n, v in zip(("structural", "organization", "metadata", "extractability"), read, strict=True)], agents.readability(read).alias("overall"), agents.semantic_usage(sum((count(t) for t in ("article", "section", "nav", "header", "footer", "main", "aside")), F.lit(0))).alias("semantic_usage"),
            agents.heading_quality(heads[0], heads[1]).alias("heading_quality"), (m["has_main"] | m["has_article"]).alias("has_main_content"), (m["has_json_ld"] | m["has_microdata"]).alias("has_structured_data"), agents.percent(F.col("body_text_length"), F.col("page_size")).alias("text_percent"),
            agents.percent(F.col("hidden_elements"), F.col("total_elements")).alias("hidden_percent"), count("p").alias("paragraphs"), m["n_lists"].alias("lists"), count("table").alias("tables"), (count("pre") + count("code")).alias("code_blocks"), "total_elements",
        ),
        "http_status_report": status.filter("status_code <> 200"),
        "llm_general_suitability": said.select(
            "url", source.alias("html_source"), served.alias("served_score"), rendered_score.alias("rendered_score"), agents.status(served).alias("status"), agents.feedback(m, F.lit(config.rendered)).alias("feedback"), "has_llms_txt", *[m[c].alias(c) for c in ("has_main", "has_nav", "has_agent_visible")],
            whole(F.col("name_ratio")).alias("standard_percent"), whole(F.col("autocomplete_ratio")).alias("autocomplete_percent"), "has_schema_org", backend["has_llms_txt"].alias("site_has_llms_txt"), "has_ai_txt", "has_restrictions", "has_bot_protection", "has_api_docs",
            essential.alias("essential_issues"), (F.size("_said") - essential).alias("other_issues"), F.coalesce(F.try_element_at(F.filter("_said", lambda x: x["essential"]), F.lit(1))["issue"], F.lit("None")).alias("top_issue"), F.coalesce(top["recommendation"], F.lit("None")).alias("top_recommendation"), *ranks,
        ),
        "llm_feedback": f.select("url", F.inline(agents.feedback_details(m, F.lit(config.rendered)))),
        "content_analysis": f.select(
            "url", "word_count", *[v.alias(f"h{k + 1}_count") for k, v in enumerate(heads)], markup.missing_heading_levels(heads).alias("missing_headers"), (heads[0] == 0).alias("zero_h1"), F.size("images").alias("images"), (F.size("images") - with_alt).alias("images_without_alt"), F.col("n_internal").alias("internal_links"), F.col("n_external").alias("external_links"),
            "title", "meta_description", "has_viewport", count("script").alias("scripts"), F.size(F.filter("resources", lambda r: r["type"] == "css")).alias("stylesheets"), "html_lang", "canonical", count("form").alias("forms"), count("table").alias("tables"), count("p").alias("paragraphs"), "page_size", F.size("hreflangs").alias("hreflangs"),
        ),
        "images_without_alt": image_rows.filter(F.coalesce(F.col("alt"), F.lit("")) == "").select("url", "src"),
        "image_info": image_rows.select("url", "src", "alt", "width", "height"),
        "internal_links": link_rows.filter(urls.host(F.col("target_url")) == urls.host(F.col("source_url"))).select(F.col("source_url").alias("source"), F.col("target_url").alias("target"), F.coalesce("text", F.lit("")).alias("anchor_text")),
        "llm_frontend_suitability": said.select(
            "url", source.alias("html_source"), served.alias("served_score"), rendered_score.alias("rendered_score"), "n_inputs", "name_ratio", "label_ratio", "autocomplete_ratio", count("form").alias("forms"), whole(F.col("name_ratio")).alias("standard_percent"), whole(F.col("autocomplete_ratio")).alias("autocomplete_percent"), whole(F.col("label_ratio")).alias("label_percent"),
            sum((m[f"has_{t}"].cast("int") for t in ("main", "nav", "header", "footer", "article", "section")), F.lit(0)).alias("semantic_elements"), F.col("n_state_elements").alias("state_elements"), "has_persistent_errors", "has_validation", F.col("n_agent_elements").alias("agent_elements"), F.col("n_agent_visible").alias("agent_visible"),
            F.col("n_agent_hidden").alias("agent_hidden"), "has_captcha", "captcha_type", essential.alias("essential_issues"), F.coalesce(F.nullif(F.array_join(F.transform(F.slice("_said", 1, 2), lambda x: x["recommendation"]), "; "), F.lit("")), F.lit("None")).alias("recommendations"), *ranks,
        ),
        "llm_backend_suitability": said.select(
            "url", "status_code", agents.backend_score(backend, F.col("status_code"), F.col("api_score")).alias("backend_score"), "has_schema_org", backend["has_llms_txt"].alias("has_llms_txt"), "api_score", F.col("status_code").between(200, 299).alias("status_good"), (urls.scheme(F.col("url")) == "https").alias("https"),
            *[m[c].alias(c) for c in ("has_hsts", "has_csp", "has_frame_options")], F.size("json_ld").alias("json_ld"), F.coalesce("llms_href", F.lit("N/A")).alias("llms_href"), "has_ai_txt", "has_restrictions", F.coalesce(F.nullif("robots_meta", F.lit("")), F.lit("N/A")).alias("robots_meta"), "has_api_docs", "has_openapi",
            *[F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*[F.when(when, text) for when, text in rules])), "; "), F.lit("")), F.lit("None")).alias(name) for name, rules in agents.backend_rules(backend, F.col("status_code"), urls.scheme(F.col("url")) == "https").items()], *ranks,
        ),
        "robots_txt_quality": robots_quality,
        "llms_txt_quality": llms_quality,
        "failed_urls": failed,
        "pass_counts": spark.createDataFrame([(int(counts["pages"]), int(counts["failed"]))], "pages bigint, failed bigint"),
        "technologies": technology.by_category(technology.detect(resources)),
    }
    if sitemap is not None:
        out["missing_sitemap_urls"] = links.discovered(internal, sitemap)
        out["orphaned_urls"] = links.orphans(sitemap, internal)
        out["perfected_sitemap"] = links.perfected_sitemap(sitemap, pages, internal)
    if issues is not None:
        found = rollups.issue_analysis(issues).withColumnRenamed("page_url", "url")
        out["accessibility_report"] = f.select("url").join(found, "url", "left").fillna(0, [c for c in found.columns if c not in ("url", "score", "manual_checks")]).withColumn("score", F.coalesce("score", F.lit(100)))
        out["wcag_compliance"] = rollups.guideline_compliance(issues)
        out["accessibility_issues"] = rollups.enriched(issues)
        out["issues_by_code"] = rollups.issues_by_page_and_code(issues)
        out["common_issues"] = rollups.common_issues(issues)
    own = m | {"n_structured": F.size("json_ld"), "n_forms": count("form"), "robots_score": F.col("robots_score"), "n_standard_names": F.col("n_standard_names")}
    measures = ("has_main", "has_nav", "has_header", "has_footer", "has_article", "has_section", "n_structured", "n_forms", "n_standard_names", "has_persistent_errors", "has_validation", "has_loading", "has_agent_visible", "has_llms_txt")
    flags = f.select("url", F.struct(*[own[c].alias(c) for c in measures]).alias("m"), patterns.served_score(own).alias("served_score"), patterns.rendered_score(own).alias("rendered_score"))
    out["patterns"] = patterns.extract(flags, config.pattern_score_threshold, config.pattern_score_threshold, config.pattern_examples, lambda c: F.col(f"m.{c}"))
    addresses = rest.select("url", "status_code", (F.startswith("url", F.lit(config.base_url)) if config.base_url else F.lit(True)).alias("is_internal"), ((F.col("status_code") == 200) & ~F.contains(F.coalesce(F.col("html"), F.lit("")), F.lit("noindex"))).alias("indexable"))
    contents = out["content_analysis"].join(out["security_report"].drop("https"), "url").withColumn("js_errors", F.lit(0))
    first = rollups.address_sections(addresses)
    more = rollups.other_sections(out["seo_scores"], out["performance_analysis"], out.get("orphaned_urls"), issues, config.base_url)
    first = first.withColumn("position", F.col("position") + 1).unionByName(rollups.page_sections(contents).withColumn("position", F.col("position") + 100))
    out["seo_sections"] = first.withColumn("comment", F.lit(None).cast("string")).unionByName(more)
    out["seo_advice"] = rollups.section_advice(out["seo_sections"])
    out["seo_scores_summary"] = rollups.summarize(out["seo_scores"], ["score", *parts])
    return out | summaries(out) | charts(out)


def _beside(frames: list[DataFrame]) -> DataFrame:
    """One-row tables as one row."""
    out = frames[0].withColumn("_one", F.lit(1))
    for frame in frames[1:]:
        out = out.join(frame.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def summaries(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One-row summaries by category, the headline, findings and recommendations, from an audit's report tables."""
    none = found["performance_analysis"].sparkSession.createDataFrame([], "type string, page_url string")
    issues = found.get("accessibility_issues", none)
    pages = found["content_analysis"].agg(F.count(F.lit(1)).alias("n")).first()["n"]
    out = {
        "summary_performance": rollups.performance_summary(found["performance_analysis"]),
        "summary_accessibility": rollups.accessibility_summary(issues, F.lit(pages)),
        "summary_seo": rollups.seo_score_summary(found["seo_scores"]),
        "summary_content": rollups.content_summary(found["content_analysis"]),
        "summary_agents": rollups.agent_summary(found["llm_general_suitability"]),
    }
    parts = [out["summary_performance"].select(F.col("load_time"), F.col("lcp"), F.col("score").alias("performance_score")), out["summary_accessibility"].select("errors", F.col("score").alias("a11y_score")), out["summary_seo"].select(F.col("score").alias("seo_score")), out["summary_content"].select("pages", "low_content_pages")]
    parts.append(out["summary_agents"].select("served_score", ((F.col("pages_with_llms_txt") > 0) | F.col("has_llms_txt_file")).alias("_refers")))
    parts.append(found["content_analysis"].agg(F.count_if(F.coalesce(F.col("meta_description"), F.lit("")) == "").alias("pages_without_description")))
    for name in ("robots", "llms"):  # the first file by address stands for the site
        file = found[f"{name}_txt_quality"].withColumn("advice", F.try_element_at("recommendations", F.lit(1)))
        parts.append(file.agg((F.count(F.lit(1)) > 0).alias(f"{name}_exists"), *[F.min_by(c, "url").alias(f"{name}_{c}") for c in ("score", "quality", "advice")]))
    one = _beside(parts).withColumns({"has_llms_txt": F.col("_refers") | F.col("llms_exists"), "llm_pages": F.col("pages")})
    one = one.withColumns({c: F.when(F.col("pages") > 0, F.col(c)) for c in ("load_time", "lcp", "seo_score", "served_score")})
    headline = rollups.headline_score([F.coalesce(c, F.lit(0)) for c in ("performance_score", "a11y_score", "seo_score", "served_score")])
    out["headline"] = one.select(headline.alias("score"), rollups.headline_label(headline).alias("label"))
    out["findings"], out["recommendations"] = rollups.findings(one), rollups.recommendations(one)
    return out


def charts(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Data of the dashboard's charts of one run, each (label, value)."""
    scores = found["seo_scores"]
    low = [("90-100", 90, None), ("80-89", 80, 90), ("70-79", 70, 80), ("60-69", 60, 70), ("<60", None, 60)]
    score = F.coalesce(F.col("score"), F.lit(0))
    bins = {name: (score >= a if a is not None else F.lit(True)) & (score < b if b is not None else F.lit(True)) for name, a, b in low}

    def averages(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        one = rows.agg(*[F.coalesce(F.avg(F.coalesce(F.expr(e).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(label) for label, e in columns.items()])
        return one.unpivot([], list(columns), "label", "value")

    out = {
        "chart_performance": averages(found["performance_analysis"], {"Load Time": "load_time", "LCP": "lcp", "FCP": "fcp", "CLS": "cls"}),
        "chart_seo_distribution": rollups.melt_counts(scores, bins).select(F.col("section").alias("label"), F.col("n").cast("double").alias("value")),
        "chart_content": averages(found["content_analysis"], {"Avg Word Count": "word_count", "Avg Headings": "h1_count + h2_count + h3_count + h4_count + h5_count + h6_count", "Avg Paragraphs": "paragraphs"}),
        "chart_agents": averages(found["llm_general_suitability"], {"Served Score": "served_score", "Rendered Score": "rendered_score"}),
    }
    if "accessibility_issues" in found:
        out["chart_accessibility"] = rollups.melt_counts(found["accessibility_issues"], {t: F.col("type") == t for t in ("error", "warning", "notice")}).select(F.col("section").alias("label"), F.col("n").cast("double").alias("value"))
    return out


def trend_charts(stored: DataFrame) -> dict[str, DataFrame]:
    """Data of the dashboard's charts over runs, each (site, run_ts, label, value)."""
    series = {"chart_performance_trend": {"load_time": "Load Time (ms)", "lcp": "LCP (ms)", "fcp": "FCP (ms)"}, "chart_accessibility_trend": {"a11y_total": "Total Issues", "a11y_errors": "Errors"}}
    names = {k: F.create_map(*[F.lit(x) for pair in v.items() for x in pair]) for k, v in series.items()}
    return {k: stored.filter(F.col("metric").isin(*v)).select("site", "run_ts", F.try_element_at(names[k], F.col("metric")).alias("label"), "value") for k, v in series.items()}


def site_metrics(found: dict[str, DataFrame]) -> DataFrame:
    """(site, family, metric, value) of one audit, for the run history: averages and counts of its report tables by site (host)."""

    def by_site(name: str, family: str, metrics: dict[str, Column], url: str = "url") -> DataFrame:
        wide = found[name].groupBy(urls.host(F.col(url)).alias("site")).agg(*[v.cast("double").alias(k) for k, v in metrics.items()])
        return wide.unpivot(["site"], list(metrics), "metric", "value").select("site", F.lit(family).alias("family"), "metric", "value")

    mean = lambda c: F.avg(F.coalesce(F.expr(c).cast("double"), F.lit(0.0)))
    rows = [
        by_site("seo_scores", "seo", {"seo_score": mean("score"), "url_count": F.count(F.lit(1))}),
        by_site("llm_general_suitability", "agents", {c: mean(c) for c in ("served_score", "rendered_score")}),
        by_site("performance_analysis", "performance", {c: mean(c) for c in ("load_time", "lcp", "fcp", "cls", "tti", "tbt")}),
        by_site("content_analysis", "content", {"word_count": mean("word_count"), "heading_count": mean("h1_count + h2_count + h3_count")}),
    ]
    if "accessibility_issues" in found:
        kind = F.col("type")
        rows.append(by_site("accessibility_issues", "accessibility", {"a11y_total": F.count_if(kind.isin("error", "warning", "notice")), **{f"a11y_{t}s": F.count_if(kind == t) for t in ("error", "warning", "notice")}}, "page_url"))
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


def run(pages: DataFrame, config: AuditConfig, run_id: str, run_ts, **inputs: DataFrame | None) -> dict[str, DataFrame]:
    """Audit, write all reports, summaries and chart data, and if a history folder is set store the run, and compare it with the run before and with the pinned baseline."""
    spark = pages.sparkSession
    found = audit(pages, config, **inputs)
    for name in reports.REPORTS:
        if name in found:
            reports.write_report(name, found[name], config.output)
    if "perfected_sitemap" in found:
        reports.write_sitemap(found["perfected_sitemap"], f"{config.output}/v-sitemap")
    if config.history:
        metrics = site_metrics(found).select(F.lit(run_id).alias("run_id"), F.lit(run_ts).cast("timestamp").alias("run_ts"), "site", "family", "metric", "value")
        store = RunStore(spark, config.history)
        store.write(metrics)
        stored = store.metrics()
        name = spark.range(1).select(run_key(F.lit(run_ts).cast("timestamp"), F.lit(run_id))).first()[0]
        found["comparison"] = history.compare_previous(stored).filter(F.col("run") == name)
        found["regressions"] = store.regressions(name)
        found |= trend_charts(stored)
        reports.write_lines(reports.regression_report(found["regressions"], store.baseline() is not None), f"{config.output}/regression_report.md")
        if config.establish_baseline:  # what follows is compared with this run
            store.pin(run=name)
    names = ["headline", *(n for n in found if n.startswith("summary_")), "findings", "recommendations", "seo_advice"]
    small = {n.removeprefix("summary_"): reports.small_rows(found[n]) for n in names}
    reports.write_text(spark, reports.executive_summary(small), f"{config.output}/executive_summary.md")
    reports.write_text(spark, reports.as_json(small), f"{config.output}/executive_summary.json")
    reports.write_text(spark, reports.pattern_library(found["patterns"]), f"{config.output}/pattern_library.md")
    reports.write_text(spark, reports.ai_files_summary(found["robots_txt_quality"], found["llms_txt_quality"]), f"{config.output}/ai_files_summary.md")
    if "wcag_compliance" in found:
        reports.write_text(spark, reports.executive_summary({"accessibility": small["accessibility"], "guidelines": reports.small_rows(found["wcag_compliance"])}, "Accessibility"), f"{config.output}/accessibility_report.md")
    for name in found:
        if name.startswith("chart_"):
            reports.write_csv(found[name], f"{config.output}/charts/{name.removeprefix('chart_')}", order=["run_ts", "label"] if "run_ts" in found[name].columns else ["label"])
    return found

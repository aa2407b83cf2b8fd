"""Writers of reports: CSV files, Markdown, sitemap XML and stored runs. Formatting happens here and nowhere else."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.patterns import LIBRARY


def two_decimals(value: Column) -> Column:
    """'95.12', and '0.00' for what is not a number."""
    return F.when(value.isNull(), "0.00").otherwise(F.format_string("%.2f", value.cast("double")))


def yes_no(value: Column) -> Column:
    return F.when(value, "Yes").otherwise("No")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", order: list[str] | None = None) -> None:
    """All values quoted, quotes doubled, nulls as empty strings; arrays, maps and structs as JSON.

    Rows are gathered into parts of Spark's advisory size, so a small report is one file and no part has a header alone; with
    ``order`` (names, falling with a leading '-') parts follow each other in that order."""
    write_csv_as_is(df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]) if order else df.hint("rebalance"), path, mode)


def write_csv_as_is(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """As write_csv, in the partitions and the order that ``df`` has."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


#: Columns of the reports, by name. A report's table must have them; the writers select and order.
REPORTS = {
    "seo_report": ["url", "title", "title_length", "meta_description", "description_length", "h1", "h1_count", "word_count", "images", "images_without_alt", "internal_links", "canonical", "html_lang", "has_viewport", "has_schema_org"],
    "performance_analysis": ["url", "load_time", "dom_content_loaded", "first_paint", "fcp", "lcp", "tti", "tbt", "cls"],
    "seo_scores": ["url", "score", "title", "meta_description", "h1", "content_quality", "internal_linking", "image_alt", "security", "page_speed"],
    "accessibility_report": ["url", "score", "issues", "critical", "serious", "moderate", "minor", "level_a", "level_aa", "level_aaa", "aria", "contrast", "keyboard", "manual_checks"],
    "image_optimization": ["url", "src", "alt", "format", "size", "width", "height", "score", "alt_score", "optimization", "loading", "srcset"],
    "link_analysis": ["source_url", "target_url", "text", "type", "status", "redirects", "content_type", "in_navigation", "depth", "score", "rel"],
    "content_quality": ["url", "word_count", "heading_score", "freshness_score", "media_score", "uniqueness", "grammar", "score"],
    "security_report": ["url", "https", "has_hsts", "has_csp", "has_frame_options", "has_content_type_options"],
    "all_resources_report": ["url", "type", "uses"],
    "missing_sitemap_urls": ["url", "pages"],
    "llm_readability_report": ["url", "overall", "structural", "organization", "metadata", "extractability", "semantic_usage", "heading_quality", "has_main_content", "has_structured_data", "text_percent", "hidden_percent", "paragraphs", "lists", "tables", "code_blocks", "total_elements"],
    "http_status_report": ["url", "status_code", "status_text", "ts"],
    "llm_general_suitability": ["url", "html_source", "served_score", "rendered_score", "has_main", "has_nav", "standard_percent", "autocomplete_percent", "has_schema_org", "site_has_llms_txt", "has_ai_txt", "has_restrictions", "has_bot_protection", "has_api_docs", "has_agent_visible", "essential_issues", "other_issues", "top_issue", "top_recommendation", "priority", "effort", "status", "feedback"],
    "llm_frontend_suitability": ["url", "html_source", "served_score", "forms", "standard_percent", "autocomplete_percent", "label_percent", "semantic_elements", "rendered_score", "state_elements", "has_persistent_errors", "has_validation", "agent_elements", "agent_visible", "agent_hidden", "has_captcha", "captcha_type", "essential_issues", "recommendations", "priority", "effort", "n_inputs", "name_ratio", "label_ratio", "autocomplete_ratio"],
    "llm_backend_suitability": ["url", "backend_score", "status_code", "status_good", "https", "has_hsts", "has_csp", "has_frame_options", "has_schema_org", "json_ld", "has_llms_txt", "llms_href", "has_ai_txt", "has_restrictions", "robots_meta", "has_api_docs", "api_score", "has_openapi", "issues", "recommendations", "priority", "effort"],
    "robots_txt_quality": ["url", "exists", "quality", "score", "max_score", "has_ai_agents", "ai_agent_names", "has_sitemap", "sitemaps", "protects_paths", "paths", "mentions_llms", "has_comments", "rules", "structure", "issues", "recommendations"],
    "llms_txt_quality": ["url", "exists", "quality", "score", "max_score", "has_title", "title", "has_description", "has_contact", "contact", "has_last_updated", "last_updated", "has_site_type", "site_type", "core_elements", "core_total", "sections", "sections_total", "word_count", "line_count", "n_links", "n_headings", "length", "specificity", "structured", "issues", "recommendations"],
    "llm_feedback": ["url", "rule", "essential", "issue", "recommendation", "priority", "effort"],
    "seo_sections": ["section", "item", "value", "percent", "comment"],
    "seo_scores_summary": ["metric", "average", "least", "most"],
    "content_analysis": ["url", "word_count", "h1_count", "h2_count", "h3_count", "h4_count", "h5_count", "h6_count", "missing_headers", "zero_h1", "images", "images_without_alt", "internal_links", "external_links", "title", "meta_description", "has_viewport", "scripts", "stylesheets", "html_lang", "canonical", "forms", "tables", "page_size"],
    "images_without_alt": ["url", "src"],
    "image_info": ["url", "src", "alt", "width", "height"],
    "internal_links": ["source", "target", "anchor_text"],
    "orphaned_urls": ["url"],
    "accessibility_issues": ["page_url", "code", "message", "type", "severity", "level", "guideline", "guideline_name", "remediation", "manual_check"],
    "issues_by_code": ["page_url", "code", "n", "type", "message", "severity", "level", "guideline", "guideline_name", "remediation", "manual_check"],
    "common_issues": ["code", "message", "n"],
    "wcag_compliance": ["guideline", "name", "issues", "compliant", "manual_check"],
    "technologies": ["category", "names"],
    "failed_urls": ["url", "status_code", "reason", "attempts"],
    "pass_counts": ["pages", "failed"],
}


#: Order of the reports that have one.
ORDERS = {"failed_urls": ["url", "reason"], "all_resources_report": ["-uses", "url"], "llm_readability_report": ["-overall", "url"], "http_status_report": ["-status_code", "url"], "missing_sitemap_urls": ["url"], "orphaned_urls": ["url"], "common_issues": ["-n", "code", "message"], "wcag_compliance": ["guideline"], "issues_by_code": ["page_url", "code"]}


def write_report(name: str, df: DataFrame, folder: str) -> None:
    """One of REPORTS as CSV in ``folder``."""
    if name == "seo_sections":
        df = df.orderBy("position").coalesce(1)  # as many rows as the report has lines
        write_csv_as_is(df.select(*REPORTS[name]), f"{folder}/{name}")
        return
    write_csv(df.select(*REPORTS[name]), f"{folder}/{name}", order=ORDERS.get(name))


def small_rows(df: DataFrame, most: int = 1000) -> list[dict]:
    """A small result on the driver. Refuses tables of more than ``most`` rows, which do not belong there."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def markdown_table(df: DataFrame | list[dict], most: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df if isinstance(df, list) else small_rows(df, most)
    names = list(rows[0]) if rows else [] if isinstance(df, list) else df.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)] if names else ["none"]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r.values()) + " |" for r in rows]
    return "\n".join(lines)


def executive_summary(parts: dict[str, DataFrame | list[dict]], title: str = "Audit summary") -> str:
    """Small result tables under headings, in order."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in parts.items())])


def as_json(parts: dict[str, list[dict]]) -> str:
    """The same as JSON: one object, with a list of rows for each part."""
    return json.dumps(parts, ensure_ascii=False, default=str)


def pattern_library(examples: DataFrame) -> str:
    """Markdown of all patterns: what each is, its examples (rank, url, score), and how to get there."""
    found: dict[str, list[dict]] = {}
    for row in small_rows(examples):
        found.setdefault(row["pattern"], []).append(row)
    out = ["# Pattern library"]
    for name, (title, text, priority, effort, advice) in LIBRARY.items():
        rows = sorted(found.get(name, []), key=lambda r: r["rank"])
        listed = "\n".join(f"{r['rank']}. {r['url']} ({r['score']:g})" for r in rows) or "no page was good enough"
        out.append(f"## {title}\n\n{text}\n\nPriority: {priority}, effort: {effort}\n\n### Examples\n\n{listed}\n\n### Recommendations\n\n" + "\n".join(f"- {a}" for a in advice))
    return "\n\n".join(out)


def ai_files_summary(robots: DataFrame, llms: DataFrame) -> str:
    """Markdown on robots.txt and llms.txt files: how many of each quality with their average score, and how often each recommendation comes up."""
    parts = ["# Files for agents"]
    for name, df in (("robots.txt", robots), ("llms.txt", llms)):
        quality = df.groupBy("quality").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("score"), 1).alias("score")).orderBy(F.desc("score"))
        # a text may have a number in it
        advice = df.select(F.explode("recommendations").alias("recommendation")).groupBy(F.regexp_replace("recommendation", r"\d+", "N").alias("recommendation")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "recommendation")
        parts += [f"## {name}", markdown_table(quality), markdown_table(advice)]
    return "\n\n".join(parts)


def regression_report(found: DataFrame, baseline: bool = True) -> DataFrame:
    """(value): the lines of a Markdown report with one section and table per severity, in order, however many regressions there are."""
    columns = [c for c in ("site", "run_ts", "metric", "old", "new", "percent") if c in found.columns]
    levels = ("critical", "warning", "info")
    spark = found.sparkSession
    counts = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["severity"]: r["n"] for r in counts}
    heads = [(0, 0, "# Regressions"), (0, 1, ""), (0, 2, f"{sum(n.values())} found" if baseline else "no baseline is pinned")]
    for k, level in enumerate(levels, 1):
        heads += [(k, 0, ""), (k, 1, f"## {level}"), (k, 2, "")]
        heads += [(k, 3, "| " + " | ".join(columns) + " |"), (k, 4, "|" + "---|" * len(columns))] if n.get(level) else [(k, 3, "none")]
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit("")) for c in columns]
    level = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("severity")).cast("int")
    rows = found.select(level.alias("_part"), F.lit(5).alias("_line"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return spark.createDataFrame(heads, "_part int, _line int, value string").unionByName(rows).orderBy("_part", "_line", "value").select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of text in their order, in as many files as they need."""
    lines.write.mode("overwrite").text(path)


def write_text(df_session, text: str, path: str) -> None:
    """One text file through Spark's file system, so remote folders work."""
    df_session.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_sitemap(df: DataFrame, path: str) -> None:
    """url (and lastmod, changefreq, priority, discovered if there) as urlset XML, in code-point order of addresses."""
    columns = [c for c in ("lastmod", "changefreq", "priority", "discovered") if c in df.columns]
    df.select(F.col("url").alias("loc"), *columns).orderBy("loc").write.mode("overwrite").format("xml").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("rowTag", "url").save(path)


def append_invalid_urls(rows: DataFrame, path: str) -> None:
    """(url, reason) appended as JSON lines."""
    rows.select("url", "reason").write.mode("append").json(path)

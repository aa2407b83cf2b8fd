"""Site-level rollups of page tables. Each is one aggregation with conditional terms, so partial sums leave each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import accessibility as a11y
from webloom.functions import seo, urls
from webloom.functions.numbers import clamp, grade, half_up, percentage, ratio


def resource_totals(resources: DataFrame, url: str = "url", page: str = "page_url", kind: str = "type") -> DataFrame:
    """Per resource: least type, uses, distinct pages."""
    return resources.groupBy(F.col(url).alias("url")).agg(F.min(kind).alias("type"), F.count(F.lit(1)).alias("uses"), F.count_distinct(page).alias("pages"))


def resource_summary(totals: DataFrame) -> DataFrame:
    return totals.groupBy("type").agg(F.count(F.lit(1)).alias("unique_resources"), F.sum("uses").alias("total_uses"))


def response_classes(pages: DataFrame, status: str = "status_code") -> DataFrame:
    return pages.groupBy((F.floor(F.col(status) / 100)).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def status_histogram(pages: DataFrame, status: str = "status_code") -> DataFrame:
    return pages.groupBy(F.col(status).alias("status_code")).agg(F.count(F.lit(1)).alias("n"))


def melt_counts(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(section, n, percent) with one row per condition, zero counts kept: one pass over the rows, then a stack of one row."""
    total = rows.agg(F.count(F.lit(1)).alias("_total"), *[F.count_if(c).alias(name) for name, c in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("section"), F.col(name).alias("n")) for name in conditions])
    return total.select("_total", F.explode(pairs).alias("_p")).select(F.col("_p.section").alias("section"), F.col("_p.n").alias("n"), percentage(F.col("_p.n"), F.col("_total")).alias("percent"))


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bucket, low, high, n) of all buckets, empty ones too; the last one includes its upper edge."""
    conditions = {}
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        conditions[f"{low:g}-{high:g}"] = (value >= low) & ((value <= high) if k == len(edges) - 2 else (value < high))
    return melt_counts(rows, conditions).select(F.col("section").alias("bucket"), "n")


def summarize(rows: DataFrame, columns: list[str], null_as_zero: bool = False) -> DataFrame:
    """(metric, average, least, most) of each column; averages skip nulls or count them as 0."""
    parts = []
    for c in columns:
        v = F.coalesce(F.col(c), F.lit(0)) if null_as_zero else F.col(c)
        parts += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}_avg"), F.min(v).cast("double").alias(f"{c}_min"), F.max(v).cast("double").alias(f"{c}_max")]
    one = rows.agg(*parts)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_avg").alias("average"), F.col(f"{c}_min").alias("least"), F.col(f"{c}_max").alias("most")) for c in columns])
    return one.select(F.explode(pairs).alias("_p")).select("_p.*")


def issue_analysis(issues: DataFrame, page: str = "page_url") -> DataFrame:
    """Per page: issues by severity and level, special kinds (told by the code alone), and a score."""
    level = F.col("code")
    rows = issues.withColumn("severity", a11y.severity(F.col("type"), level)).withColumn("level", a11y.level(level))
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in a11y.SEVERITY_WEIGHTS]
    levels = [F.count_if(F.col("level") == v).alias(f"level_{v.lower()}") for v in ("A", "AA", "AAA")]
    checks = F.array_sort(F.collect_set(a11y.named(a11y.guideline(level), a11y.MANUAL_CHECKS)))
    special = [F.count_if(F.contains(c, F.lit(w))).alias(n) for c, w, n in ((level, "ARIA", "aria"), (level, "Contrast", "contrast"), (F.lower(level), "keyboard", "keyboard"))]
    return rows.groupBy(page).agg(F.count(F.lit(1)).alias("issues"), *counts, *levels, *special, checks.alias("manual_checks"), a11y.page_score(F.sum(a11y.weight(F.col("severity")))).alias("score"))


def common_issues(issues: DataFrame, more_than: int = 1) -> DataFrame:
    """Issues by code and message that occur more often than that."""
    return issues.groupBy("code", "message").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def unrepeated(issues: DataFrame, common: DataFrame) -> DataFrame:
    """Issues that are not among the common ones; a missing message is like another missing one."""
    seen = common.select(F.col("code").alias("_code"), F.col("message").alias("_message"))
    return issues.join(seen, F.col("code").eqNullSafe(F.col("_code")) & F.col("message").eqNullSafe(F.col("_message")), "left_anti")


def enriched(issues: DataFrame) -> DataFrame:
    """Issues with severity, level, guideline and its name, advice, and what has to be checked by hand."""
    code = F.col("code")
    guideline = a11y.guideline(code)
    return issues.withColumns({
        "severity": a11y.severity(F.col("type"), code), "level": a11y.level(code), "guideline": guideline, "guideline_name": a11y.named(guideline, a11y.GUIDELINES),
        "remediation": a11y.remediation(code), "manual_check": a11y.named(guideline, a11y.MANUAL_CHECKS),
    })


def issues_by_page_and_code(issues: DataFrame) -> DataFrame:
    """Issues counted by page and code, with the least type and message, and what the code says: level, guideline, advice, and the highest severity."""
    rows = enriched(issues.select("page_url", "code", "type", "message"))
    order = F.array_position(F.array(*[F.lit(x) for x in a11y.SEVERITY_WEIGHTS]), F.col("severity"))
    return rows.groupBy("page_url", "code").agg(
        F.count(F.lit(1)).alias("n"), F.min("type").alias("type"), F.min("message").alias("message"), F.min_by("severity", order).alias("severity"), *[F.first(c).alias(c) for c in ("level", "guideline", "guideline_name", "remediation", "manual_check")]
    )


def guideline_compliance(issues: DataFrame) -> DataFrame:
    """Every guideline with its name, number of issues, whether it has none, and what has to be checked by hand."""
    spark = issues.sparkSession
    names = spark.createDataFrame([(g, name, a11y.MANUAL_CHECKS[g]) for g, name in a11y.GUIDELINES.items()], "guideline string, name string, manual_check string")
    counts = issues.groupBy(a11y.guideline(F.col("code")).alias("guideline")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "guideline", "left").select("guideline", "name", F.coalesce("n", F.lit(0)).alias("issues"), (F.coalesce("n", F.lit(0)) == 0).alias("compliant"), "manual_check")


def _sections(rows: DataFrame, items: list[tuple[str, str, Column, Column | None]]) -> DataFrame:
    """(section, item, value, percent) of aggregates in one pass; ``items``: section, item, value, and what it is a share of (null: nothing)."""
    aggregates = [c.cast("double").alias(f"_v{k}") for k, (_, _, c, _) in enumerate(items)] + [c.cast("double").alias(f"_t{k}") for k, (_, _, _, c) in enumerate(items) if c is not None]
    one = rows.agg(*aggregates)

    def percent(k: int, total: Column | None) -> Column:
        return percentage(F.col(f"_v{k}"), F.col(f"_t{k}")) if total is not None else F.lit(None).cast("double")

    made = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(section).alias("section"), F.lit(item).alias("item"), F.coalesce(F.col(f"_v{k}"), F.lit(0.0)).alias("value"), percent(k, total).alias("percent")) for k, (section, item, _, total) in enumerate(items)])
    return one.select(F.inline(made))


def address_sections(pages: DataFrame) -> DataFrame:
    """Report sections on addresses and answers: position, section, item, value, percent.

    ``pages``: url, status_code, is_internal, indexable."""
    n, total = F.count_if, F.count(F.lit(1))
    flags = urls.url_flags(F.col("url"), F.col("url"))
    internal, indexable, status = F.coalesce("is_internal", F.lit(False)), F.coalesce("indexable", F.lit(False)), F.col("status_code")
    items = [("Summary", "Total URLs", total), ("Summary", "Internal URLs", n(internal)), ("Summary", "External URLs", n(~internal)), ("Summary", "Indexable URLs", n(internal & indexable)), ("Summary", "Non-Indexable URLs", n(internal & ~indexable))]
    items += [("Response Codes", f"{k}xx", n(status.between(100 * k, 100 * k + 99))) for k in (2, 3, 4, 5)]
    named = (("has_non_ascii", "URLs with non-ASCII characters"), ("has_uppercase", "URLs with uppercase characters"), ("has_underscore", "URLs with underscores"), ("has_space", "URLs with spaces"), ("is_long", "URLs over 115 characters"))
    items += [("URL Analysis", item, n(flags[flag])) for flag, item in named]
    return _sections(pages, [(*i, total) for i in items])


def page_sections(pages: DataFrame) -> DataFrame:
    """Report sections on the contents of pages: position, section, item, value, percent.

    ``pages``: url, title, meta_description, h1_count, images, images_without_alt, internal_links, external_links, has_hsts, has_csp, has_frame_options,
    has_content_type_options, hreflangs (how many), canonical, word_count, js_errors (how many); missing numbers are 0."""
    n, total = F.count_if, F.count(F.lit(1))

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    title, description = (F.char_length(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "meta_description"))
    canonical = F.col("canonical")
    items = [
        ("Page Title Analysis", "Missing titles", n(title == 0), total), ("Page Title Analysis", "Titles over 60 characters", n(title > 60), total), ("Page Title Analysis", "Titles under 30 characters", n((title < 30) & (title > 0)), total),
        ("Meta Description Analysis", "Missing meta descriptions", n(description == 0), total), ("Meta Description Analysis", "Meta descriptions over 155 characters", n(description > 155), total), ("Meta Description Analysis", "Meta descriptions under 70 characters", n((description < 70) & (description > 0)), total),
        ("Heading Analysis", "Missing H1", n(number("h1_count") == 0), total), ("Heading Analysis", "Multiple H1s", n(number("h1_count") > 1), total),
        ("Image Analysis", "Total images", F.sum(number("images")), F.sum(number("images"))), ("Image Analysis", "Images missing alt text", F.sum(number("images_without_alt")), F.sum(number("images"))),
        ("Link Analysis", "Pages without internal links", n(number("internal_links") == 0), total), ("Link Analysis", "Pages with high number of external links", n(number("external_links") > 100), total),
        ("Security Analysis", "HTTP URLs (non-secure)", n(F.startswith(F.lower("url"), F.lit("http:"))), total),
        *(("Security Analysis", f"Missing {item}", n(~F.coalesce(F.col(c), F.lit(False))), total) for c, item in (("has_hsts", "HSTS header"), ("has_csp", "Content Security Policy"), ("has_frame_options", "X-Frame-Options header"), ("has_content_type_options", "X-Content-Type-Options header"))),
        ("Hreflang Analysis", "Pages with hreflang", n(number("hreflangs") > 0), total),
        ("Canonical Analysis", "Pages with canonical tags", F.count(canonical), total), ("Canonical Analysis", "Self-referencing canonicals", n(canonical == F.col("url")), total), ("Canonical Analysis", "Non-self canonicals", n(canonical != F.col("url")), total), ("Canonical Analysis", "Missing canonical tags", n(canonical.isNull()), total),
        ("Content Analysis", "Low content pages", n(number("word_count") < 300), total), ("Content Analysis", "Average word count", half_up(F.avg(number("word_count"))), None),
        ("JavaScript Errors Analysis", "Pages with JavaScript errors", n(number("js_errors") > 0), total),
    ]
    return _sections(pages, items)


def section_advice(sections: DataFrame) -> DataFrame:
    """Top recommendations from the rows of the sections: (position, recommendation)."""
    # by the counter that brings up each
    advice = {
        "Missing titles": "Give every page a title",
        "Titles over 60 characters": "Bring titles down to 60 characters",
        "Missing meta descriptions": "Give every page a description",
        "Missing H1": "Give every page a main heading",
        "Images missing alt text": "Say in alt what each image shows",
        "HTTP URLs (non-secure)": "Serve all pages by HTTPS",
        "Low content pages": "Say more on pages of few words",
    }
    items = F.array(*[F.lit(x) for x in advice])
    return sections.filter("value > 0").select(F.array_position(items, F.col("item")).alias("position"), a11y.named(F.col("item"), advice).alias("recommendation")).filter("position > 0")


def performance_summary(rows: DataFrame) -> DataFrame:
    """Averages, a score and its label. A null counts as 0 in an average. Load time and first paint always count towards the score, the largest
    paint if any is over 0, the layout shift if any is known."""
    mean = {c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0)) for c in ("load_time", "lcp", "fcp", "cls")}
    known = [F.coalesce(F.max(F.col("lcp") > 0), F.lit(False)).alias("_lcp"), F.coalesce(F.max(F.col("cls").isNotNull()), F.lit(False)).alias("_cls")]
    one = rows.agg(*[v.alias(k) for k, v in mean.items()], *known, F.count(F.lit(1)).alias("_n"))
    load, lcp, fcp, cls = (F.col(c) for c in mean)
    score = F.when(load < 1000, 25).when(load < 2000, 20).when(load < 3000, 15).otherwise(0)
    most = F.lit(25)
    for counts, value, good, fair in ((F.col("_lcp"), lcp, 2500, 4000), (F.lit(True), fcp, 1800, 3000), (F.col("_cls"), cls, 0.1, 0.25)):
        score = score + F.when(counts, F.when(value < good, 25).when(value < fair, 15).otherwise(0)).otherwise(0)
        most = most + F.when(counts, 25).otherwise(0)
    found = one.withColumn("score", F.when(F.col("_n") == 0, 0).otherwise(half_up(100 * score / most)))
    return found.select("load_time", "lcp", "fcp", "cls", "score", _label(F.col("score"), [(75, "Excellent"), (50, "Good"), (25, "Fair")], "Needs Improvement").alias("status"))


def _label(score: Column, limits: list[tuple[float, str]], otherwise: str) -> Column:
    return F.when(F.col("_n") == 0, "No data").otherwise(grade(score, limits, otherwise))


def accessibility_summary(issues: DataFrame, pages: Column | None = None) -> DataFrame:
    """Totals by type, score and label for a number of pages; without one, for the distinct page_url of the issues."""
    counts = [F.count_if(F.col("type") == t).alias(f"{t}s") for t in ("error", "warning", "notice")]
    if pages is None:
        counts.append(F.count_distinct("page_url").alias("_pages"))
        pages = F.col("_pages")
    one = issues.agg(*counts, F.count(F.lit(1)).alias("issues"))
    score = a11y.site_score(F.col("errors"), F.col("warnings"), F.col("notices"))
    label = grade(score, [(90, "Excellent"), (70, "Good"), (50, "Fair")], "Critical")
    return one.select("issues", "errors", "warnings", "notices", half_up(score).alias("score"), label.alias("label"), F.round(ratio(F.col("issues"), pages), 1).alias("per_page"))


def seo_score_summary(scores: DataFrame) -> DataFrame:
    """Average of column score with a label, and the number of pages; a null counts as 0."""
    one = scores.agg(F.avg(F.coalesce(F.col("score"), F.lit(0.0))).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    mean = F.coalesce("_mean", F.lit(0.0))
    return one.select(half_up(mean).alias("score"), _label(mean, [(90, "Excellent"), (80, "Very Good"), (70, "Good"), (60, "Fair")], "Needs Improvement").alias("status"), F.col("_n").alias("pages"))


def content_summary(pages: DataFrame) -> DataFrame:
    """Averages of word_count and of headings (h1, h2, h3: columns h1_count to h3_count), and pages with fewer than 300 words."""
    words = F.coalesce(F.col("word_count"), F.lit(0))
    headings = sum((F.coalesce(F.col(f"h{k}_count"), F.lit(0)) for k in (1, 2, 3)), F.lit(0))
    one = pages.agg(F.coalesce(F.avg(words), F.lit(0.0)).alias("_words"), F.coalesce(F.avg(headings), F.lit(0.0)).alias("_headings"), F.count_if(words < 300).alias("low_content_pages"), F.count(F.lit(1)).alias("pages"))
    share = F.round(100 * ratio(F.col("low_content_pages"), F.col("pages")), 1)
    return one.select("pages", half_up(F.col("_words")).alias("average_words"), F.round("_headings", 1).alias("average_headings"), "low_content_pages", share.alias("low_content_percent"))


def agent_summary(pages: DataFrame) -> DataFrame:
    """Averages of served_score and rendered_score with a label, pages that refer to llms.txt (column has_llms_txt) and whether one is that file
    (column url); that file counts as one more page."""
    file = F.coalesce(F.max(F.endswith("url", F.lit("/llms.txt"))), F.lit(False))
    one = pages.agg(F.avg("served_score").alias("_served"), F.avg("rendered_score").alias("_rendered"), F.count_if("has_llms_txt").alias("_refer"), file.alias("has_llms_txt_file"), F.count(F.lit(1)).alias("_n"))
    served = F.coalesce("_served", F.lit(0.0))
    return one.select(
        half_up(served).alias("served_score"), half_up(F.coalesce("_rendered", F.lit(0.0))).alias("rendered_score"), _label(served, [(70, "Good"), (50, "Fair")], "Needs Improvement").alias("status"),
        (F.col("_refer") + F.col("has_llms_txt_file").cast("int")).alias("pages_with_llms_txt"), "has_llms_txt_file",
    )


def _said(text: str, *values: Column) -> Column:
    return F.format_string(text, *values) if values else F.lit(text)


def _file_rules(name: str, limit: int, low: int, text: str, missing: str) -> list[tuple]:
    """Rules about a file's quality: too low (of higher rank below ``low``), or the file is known to be missing."""
    exists, score, quality = (F.col(f"{name}_{c}") for c in ("exists", "score", "quality"))
    return [("AI Compatibility", F.when(score < low, "Medium").otherwise("Low"), exists & (score < limit), _said(text, quality, score.cast("long"))), ("AI Compatibility", F.lit("Low"), ~exists, _said(missing))]


def finding_rules() -> list[tuple]:
    """Category, severity, condition and text of what a summary can show, in order."""
    load, seo, low = F.col("load_time"), F.col("seo_score"), F.col("low_content_pages")
    return [
        ("Performance", F.lit("High"), load > 3000, _said("Pages take %d ms to load on average; 3000 ms is the limit", half_up(load))),
        ("Accessibility", F.lit("Critical"), F.col("errors") > 0, _said("Accessibility errors on all pages together: %d", F.col("errors"))),
        ("SEO", F.lit("Medium"), seo < 70, _said("The average search score is %d; it should reach 70", half_up(seo))),
        ("Content", F.lit("Medium"), low > 0.2 * F.col("pages"), _said("Pages of fewer than 300 words: %d, a share of %d%%", low, half_up(100 * ratio(low, F.col("pages"))))),
        ("LLM Suitability", F.lit("Low"), ~F.col("has_llms_txt") & (F.col("llm_pages") > 0), _said("The site tells language models nothing of itself, as it has no llms.txt")),
        *_file_rules("robots", 60, 40, "The robots.txt is rated %s, %d of 100 points", "The site has no robots.txt"),
        *_file_rules("llms", 70, 50, "The llms.txt is rated %s, %d of 100 points", "The site has no llms.txt"),
    ]


def recommendation_rules() -> list[tuple]:
    """Category, priority, condition and text of what to do, in order."""

    def of_file(name: str, limit: int, low: int, missing: str) -> list[tuple]:
        exists, score, advice = (F.col(f"{name}_{c}") for c in ("exists", "score", "advice"))
        return [("AI Compatibility", F.when(score < low, "Medium").otherwise("Low"), exists & (score < limit) & advice.isNotNull(), _said(f"{name}.txt: %s", advice)), ("AI Compatibility", F.lit("Low"), ~exists, _said(missing))]

    return [
        ("Performance", F.lit("High"), F.col("lcp") > 2500, _said("Let the largest element appear sooner: serve smaller images and load scripts after it")),
        ("Accessibility", F.lit("Critical"), F.col("errors") > 0, _said("Mend the accessibility errors before anything else")),
        ("SEO", F.lit("Medium"), F.col("pages_without_description") > 0, _said("Write a description for each page that has none; there are %d", F.col("pages_without_description"))),
        ("Content", F.lit("Medium"), F.col("low_content_pages") > 0, _said("Say more on short pages, or join them; there are %d", F.col("low_content_pages"))),
        ("LLM Suitability", F.lit("Low"), (F.col("served_score") < 50) & (F.col("llm_pages") > 0), _said("Mark the parts of pages by their elements and describe their subject in JSON-LD")),
        *of_file("robots", 60, 40, "Publish a robots.txt that names the crawlers of language models and the sitemap"),
        *of_file("llms", 70, 50, "Publish an llms.txt with what the site offers and what may be done with it"),
    ]


def _applied(summary: DataFrame, keys: list[str], rules: list[tuple], rank: str, text: str) -> DataFrame:
    rows = [F.when(when, F.struct(F.lit(k).alias("position"), F.lit(category).alias("category"), level.alias(rank), said.alias(text))) for k, (category, level, when, said) in enumerate(rules)]
    return summary.select(*keys, F.inline(F.array_compact(F.array(*rows))))


def findings(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, position, category, severity, finding) of all findings that apply to a summary's rows.

    Columns read: load_time, errors, seo_score, pages, low_content_pages, has_llms_txt, llm_pages, and exists, score and quality of both files
    (robots_..., llms_...). What is null was not measured and shows nothing."""
    return _applied(summary, keys or [], finding_rules(), "severity", "finding")


def recommendations(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, position, category, priority, recommendation), from the columns of ``findings`` and lcp, pages_without_description, served_score,
    robots_advice and llms_advice (a file's first recommendation)."""
    return _applied(summary, keys or [], recommendation_rules(), "priority", "recommendation")


def join_reports(one: DataFrame, other: DataFrame, on: str = "url") -> DataFrame:
    """Rows that two reports have in common by ``on``, with the columns of both; of columns that both have, the first one's."""
    return one.join(other.drop(*(c for c in other.columns if c in one.columns and c != on)), on)


def headline_score(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return half_up(clamp(total / len(parts)))


def headline_label(score: Column) -> Column:
    return grade(score, [(80, "Excellent"), (70, "Good"), (60, "Fair"), (40, "Needs Improvement")], "Critical")


def overview(pages: DataFrame) -> DataFrame:
    """Pages, site name by the first URL, and whether the first page tells when it was modified (columns position, host, last_modified)."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.min_by("host", "position").alias("site"), F.min_by(F.col("last_modified").isNotNull(), "position").alias("tells_last_modified"))


#: Upper limits in milliseconds of the comments on average timings.
TIMING_LIMITS = {
    "load_time": ("Average Load Time", (1000, 2000, 3000)),
    "first_paint": ("Average First Paint", (1000, 2000, 3000)),
    "fcp": ("Average First Contentful Paint", (1500, 2500, 4000)),
}


def timing_comment(value: Column, limits: tuple[int, int, int]) -> Column:
    """Label of an average timing; 'N/A' where none was measured."""
    return F.when(value.isNull(), "N/A").when(value <= limits[0], "Excellent").when(value <= limits[1], "Good").when(value <= limits[2], "Fair").otherwise("Needs Improvement")


def other_sections(scores: DataFrame, timings: DataFrame, orphans: DataFrame | None = None, issues: DataFrame | None = None, base: str = "") -> DataFrame:
    """Report sections beside those of addresses and pages: position, section, item, value, percent, comment. ``scores``: url, score; ``timings``: columns of
    TIMING_LIMITS, whose nulls are left out of averages; ``orphans``: url; ``issues``: type. What is not given has no section but the site's, and no scores have null values."""
    spark = scores.sparkSession
    rows = "position int, section string, item string, value double, percent double, comment string"
    parts = [spark.createDataFrame([(0, "Header", base, None, None, None)], rows)]
    pages = scores.agg(F.count(F.lit(1)).alias("_pages"))
    if orphans is not None:
        one = orphans.agg(F.count(F.lit(1)).cast("double").alias("_n")).join(pages, F.lit(True))
        parts.append(one.select(F.lit(1000).alias("position"), F.lit("Orphaned URLs Analysis").alias("section"), F.lit("Orphaned URLs").alias("item"), F.col("_n").alias("value"), percentage(F.col("_n"), F.col("_pages")).alias("percent"), F.lit(None).cast("string").alias("comment")))
    if issues is not None:
        counts = issues.rollup("type").agg(F.count(F.lit(1)).cast("double").alias("value"), F.grouping_id().alias("_all")).filter("_all = 1 OR type IS NOT NULL")
        kind = F.when(F.col("_all") == 1, "Total issues").otherwise(F.concat("type", F.lit(" issues")))
        place = F.when(F.col("_all") == 1, 1100).otherwise(1101 + F.coalesce(F.array_position(F.array(F.lit("error"), F.lit("warning"), F.lit("notice")), F.col("type")), F.lit(9)))
        parts.append(counts.select(place.cast("int").alias("position"), F.lit("Accessibility Analysis").alias("section"), kind.alias("item"), "value", F.lit(None).cast("double").alias("percent"), F.lit(None).cast("string").alias("comment")))

    def listed(one: DataFrame, first: int, section: str, items: list[tuple[str, Column, Column]]) -> DataFrame:
        made = F.array(*[F.struct(F.lit(first + k).alias("position"), F.lit(section).alias("section"), F.lit(item).alias("item"), value.alias("value"), F.lit(None).cast("double").alias("percent"), said.alias("comment")) for k, (item, value, said) in enumerate(items)])
        return one.select(F.inline(made))

    mark = F.col("score").cast("double")
    one = scores.agg(F.avg(mark).alias("a"), F.min(mark).alias("b"), F.max(mark).alias("c"))
    parts.append(listed(one, 1200, "SEO Score Analysis", [("Average SEO Score", F.round("a", 2), seo.comment(F.col("a"))), ("Lowest SEO Score", F.col("b"), seo.comment(F.col("b"))), ("Highest SEO Score", F.col("c"), seo.comment(F.col("c")))]))
    one = timings.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in TIMING_LIMITS])
    parts.append(listed(one, 1300, "Performance Analysis", [(item, F.round(F.col(c), 2), timing_comment(F.col(c), limits)) for c, (item, limits) in TIMING_LIMITS.items()]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

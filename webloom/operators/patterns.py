"""Exemplary pages: those that score well, as examples of six patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.numbers import half_up, points, ratio

#: Pattern names and what makes a page an example, over columns of the scored page table.
PATTERNS = {
    "structured_data": lambda c: c("n_structured") > 0,
    "semantic": lambda c: sum((c(x).cast("int") for x in ("has_main", "has_nav", "has_header", "has_footer", "has_article", "has_section")), F.lit(0)) >= 4,
    "forms": lambda c: (c("n_forms") > 0) & (c("n_standard_names") > 0),
    "errors": lambda c: c("has_persistent_errors"),
    "state": lambda c: c("has_validation") | c("has_loading") | c("has_agent_visible"),
    "llms_txt": lambda c: c("has_llms_txt"),
}


def served_score(m: dict[str, Column]) -> Column:
    """The selection's own score of a page as served, 0 to 100. ``m``: has_main, has_nav, has_header, has_footer, has_article, has_section, n_structured, n_forms,
    n_standard_names, n_inputs, has_llms_txt, has_hsts, has_csp, has_frame_options, has_content_type_options, robots_score."""
    fixed = points([(m["has_main"], 5), (m["has_nav"], 3), (m["has_header"], 3), (m["has_footer"], 3), (m["has_article"], 3), (m["has_section"], 3), (m["has_llms_txt"], 10), (m["has_hsts"], 3), (m["has_csp"], 3), (m["has_frame_options"], 2), (m["has_content_type_options"], 2)])
    standard = F.when(m["n_forms"] > 0, m["n_standard_names"] / F.greatest(m["n_inputs"], F.lit(1))).otherwise(0.0)
    return F.least(F.lit(100.0), fixed + F.least(F.lit(25), 8 * m["n_structured"]) + half_up(15 * standard) + half_up(ratio(F.coalesce(m["robots_score"], F.lit(0)), F.lit(100)) * 15))


def rendered_score(m: dict[str, Column]) -> Column:
    """The selection's own score of a rendered page, 0 to 100. ``m``: has_validation, has_loading, has_agent_visible, n_required, has_persistent_errors, has_live, has_invalid, has_alert."""
    return F.least(F.lit(100.0), points([(m["has_validation"], 10), (m["has_loading"], 10), (m["has_agent_visible"], 10), (m["n_required"] > 0, 20), (m["has_persistent_errors"], 25), (m["has_live"], 10), (m["has_invalid"], 10), (m["has_alert"], 5)]))


#: Name (fixed values), what it is, priority and effort (fixed values) of each pattern, and how to get there.
LIBRARY = {
    "structured_data": ("Structured Data (JSON-LD)", "The page describes its subject in a form that needs no reading", "Critical", "Low", ["Put one JSON-LD block into the page for each thing it is about", "Choose the narrowest type that is true", "Write nothing into it that a reader cannot see", "Run a validator over the block whenever the page changes"]),
    "semantic": ("Semantic HTML Structure", "Elements tell what each part of the page is", "Critical", "Low", ["Let main hold what the page is for, and nothing else", "Keep menus in nav, so that readers can skip them", "Use article for what could stand alone and section for its parts", "Let headings form an outline without gaps"]),
    "forms": ("Standard Form Field Naming", "Fields have the names that other sites use", "High", "Low", ["Call a field by what goes into it, in words that are common", "Repeat that in autocomplete, from the list of the standard", "Tie a label to each field by its id", "Where a label is not shown, say it in aria-label"]),
    "errors": ("Persistent Error Messages", "What went wrong stays in the page until it is put right", "Critical", "Moderate", ["Write errors into the page, not into something that fades", "Announce them by role and live region", "List all of them at the top of the form, each with a link to its field", "Take a message away only when its cause has gone"]),
    "state": ("Explicit State Attributes", "Scripts write what they know into attributes", "High", "Moderate", ["Reflect the state of each changing element in data-state", "Show whether a field has been checked in data-validation-state", "Say that something is loading while it is", "Give the reason beside a control that is switched off", "Mark what is meant for programs, and what is not, by data-agent-visible"]),
    "llms_txt": ("llms.txt Implementation", "One file tells programs what the site offers and allows", "High", "Low", ["Publish the file at /llms.txt and name it in the head of every page", "Open with the site's name and a sentence on it", "State limits, closed areas and terms of use", "Link to interfaces and their documentation", "Date the file and name somebody to ask"]),
}


def extract(pages: DataFrame, least_served: float = 70, least_rendered: float = 70, most: int = 5, column: Callable[[str], Column] = F.col) -> DataFrame:
    """(pattern, rank, url, score): up to ``most`` examples of each pattern among pages that pass both scores, best first. ``column``
    finds the measures by name, for pages that hold them in a struct.

    The ranking runs over rows that already passed, keyed by pattern, and Spark prunes each task to its own best before the
    shuffle (a window group limit)."""
    good = pages.filter((F.col("served_score") >= least_served) & (F.col("rendered_score") >= least_rendered))
    names = F.array_compact(F.array(*[F.when(rule(column), F.lit(name)) for name, rule in PATTERNS.items()]))
    rows = good.select("url", (F.col("served_score") + F.col("rendered_score")).alias("score"), F.explode(names).alias("pattern"))
    order = Window.partitionBy("pattern").orderBy(F.desc("score"), "url")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

"""Severity, guideline and score expressions of accessibility issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guidelines with their names, what has to be checked by hand for each, and weights of severities.
GUIDELINES = {
    "1.1": "Text Alternatives",
    "1.2": "Time-based Media",
    "1.3": "Adaptable",
    "1.4": "Distinguishable",
    "2.1": "Keyboard Accessible",
    "2.2": "Enough Time",
    "2.3": "Seizures and Physical Reactions",
    "2.4": "Navigable",
    "2.5": "Input Modalities",
    "3.1": "Readable",
    "3.2": "Predictable",
    "3.3": "Input Assistance",
    "4.1": "Compatible",
}
MANUAL_CHECKS = {
    "1.1": "Read the page without images: is anything lost?",
    "1.2": "Play films and sound: are there captions and a transcript?",
    "1.3": "Listen to headings, lists and tables with a screen reader",
    "1.4": "Measure contrasts, and enlarge the text to twice its size",
    "2.1": "Use everything without a mouse",
    "2.2": "Wait: does anything run out that cannot be extended?",
    "2.3": "Watch for anything that flashes",
    "2.4": "Go through links and fields by tab: is the order sensible?",
    "2.5": "Do without gestures what gestures do",
    "3.1": "Look whether the language of page and quotations is marked",
    "3.2": "Compare menus and names across pages",
    "3.3": "Fill forms wrongly: are faults named and easy to mend?",
    "4.1": "Try the page with a screen reader and a voice control",
}
SEVERITY_WEIGHTS = {"Critical": 5, "Serious": 3, "Moderate": 2, "Minor": 1}


def severity(kind: Column, code: Column) -> Column:
    """From an issue's type and the start of its code (a code of level AAA also starts like AA)."""
    return (
        F.when((kind == "error") & F.startswith(code, F.lit("WCAG2AA")), "Critical")
        .when((kind == "error") & F.startswith(code, F.lit("WCAG2A")), "Serious")
        .when((kind == "warning") & F.startswith(code, F.lit("WCAG2")), "Moderate")
        .otherwise("Minor")
    )


def level(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, "WCAG2(A{1,3})", 1), F.lit(""))


def guideline(code: Column) -> Column:
    """'1.1' from a code like WCAG2AA.Principle1.Guideline1_1.…; null if there is none."""
    both = F.concat_ws(".", F.nullif(F.regexp_extract(code, r"Guideline(\d+)_(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(code, r"Guideline(\d+)_(\d+)", 2), F.lit("")))
    return F.nullif(both, F.lit(""))


def named(guideline_: Column, table: dict[str, str]) -> Column:
    """What a table says of a guideline; null if nothing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), guideline_)


def weight(severity_: Column) -> Column:
    out = F
    for name, value in SEVERITY_WEIGHTS.items():
        out = out.when(severity_ == name, value)
    return out.otherwise(1)


def page_score(total_weight: Column) -> Column:
    """100 less twice the issues' weights; a page without issues has 100."""
    return F.greatest(F.lit(0), 100 - 2 * F.coalesce(total_weight, F.lit(0)))


def site_score(errors: Column, warnings: Column, notices: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - 5 * errors - 2 * warnings - 0.5 * notices)


def overview(issues_per_page: Column) -> Column:
    """Labels as tested in order: over 20 before over 50, so 'Poor' is never given."""
    return F.when(issues_per_page > 20, "Needs Work").when(issues_per_page > 50, "Poor").when(issues_per_page > 5, "Fair").otherwise("Good")


def remediation(code: Column) -> Column:
    """Advice in our words, by guideline."""
    advice = {"1.1": "Describe images and other non-text content.", "1.3": "Mark up structure and relations.", "1.4": "Raise contrast and let text grow.", "2.1": "Make everything work from the keyboard.", "2.4": "Name pages, links and headings clearly.", "3.1": "Declare the page's language.", "3.3": "Label fields and explain errors.", "4.1": "Use valid names, roles and values."}
    table = F.create_map(*[F.lit(x) for pair in advice.items() for x in pair])
    return F.coalesce(F.try_element_at(table, guideline(code)), F.lit("Check the page against the guideline by hand."))

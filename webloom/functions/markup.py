"""Page metrics that need no document tree, as native expressions over raw markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels that a character of a title or description takes in a result list.
PIXELS = 6

#: Texts of HTTP status codes.
STATUS_TEXTS = {
    200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request",
    401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Parts between white space; an empty text counts as one."""
    return F.size(F.split(trimmed(text), r"\s+"))


def inner(html: Column, tag: str) -> Column:
    """Content of the first element of that name, '' if none."""
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", " ")


def count_tag(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>/]"))


def title(html: Column) -> Column:
    return trimmed(inner(html, "title"))


def first_h1(html: Column) -> Column:
    return trimmed(strip_tags(inner(html, "h1")))


def meta(html: Column, name: str, attribute: str = "name") -> Column:
    """Content of the first such meta element whose name comes before its content."""
    return F.regexp_extract(html, rf"(?is)<meta\s[^>]*{attribute}\s*=\s*[\"']{name}[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"']", 1)


def html_lang(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<html[^>]*\slang\s*=\s*[\"']([^\"']*)[\"']", 1)


def body(html: Column) -> Column:
    """Everything from the body's start tag to its end tag or the page's end."""
    return F.regexp_extract(html, r"(?is)<body(?:\s[^>]*)?>(.*?)(?:</body>|$)", 1)


def text_metrics(text: Column, long: int, short: int) -> dict[str, Column]:
    """Length, width, and whether a title or description is longer or shorter than it should be."""
    n = F.char_length(text)
    return {"length": n, "width": n * PIXELS, "too_long": n > long, "too_short": (n < short) & (n > 0), "missing": n == 0}


def heading_metrics(html: Column) -> dict[str, Column]:
    h1, h2 = count_tag(html, "h1"), count_tag(html, "h2")
    return {
        "h1_length": F.char_length(first_h1(html)),
        "h1_missing": h1 == 0,
        "h1_multiple": h1 > 1,
        "h1_long": F.char_length(first_h1(html)) > 70,
        "h2_count": h2,
        "h2_missing": h2 == 0,
        "h2_many": h2 > 15,
        "h2_before_h1": (h1 > 0) & (h2 > 0) & (F.locate("<h2", F.lower(html)) < F.locate("<h1", F.lower(html))),
    }


def hrefs(html: Column) -> Column:
    """Targets of all anchors, in page order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def missing_heading_levels(counts: list[Column]) -> Column:
    """Levels without headings above the deepest level that has any, and H1 wherever there is none: as 'H2, H4', or 'None'."""
    deepest = F.greatest(F.lit(2), *[F.when(c > 0, k + 1).otherwise(0) for k, c in enumerate(counts)])
    gaps = F.array_compact(F.array(*[F.when((c == 0) & (F.lit(k + 1) < deepest), f"H{k + 1}") for k, c in enumerate(counts)]))
    return F.when(F.size(gaps) == 0, "None").otherwise(F.array_join(gaps, ", "))

"""URL expressions: parts, filters, normal forms and classes. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are not pages, ports left out, image formats known, and content types by extension.
NOT_PAGES = ("jpg", "jpeg", "png", "gif", "pdf", "zip", "css", "js")
IMAGE_FORMATS = ("jpg", "jpeg", "png", "gif", "webp", "svg")
CONTENT_TYPES = {
    "html": "text/html",
    "htm": "text/html",
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "css": "text/css",
    "js": "application/javascript",
    "json": "application/json",
    "xml": "application/xml",
    "txt": "text/plain",
}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-case host name without user and port, '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def origin(url: Column) -> Column:
    """Scheme and authority, without a default port."""
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.when(host(url) == "", "").otherwise(F.concat(scheme(url), F.lit("://"), F.regexp_replace(authority, r"^(.*?)(?::80|:443)?$", "$1")))


def path(url: Column) -> Column:
    """Path, at least '/', of a URL with a host; '' of anything else."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host(url) == "", "").otherwise(F.when(found == "", "/").otherwise(found))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def link_depth(url: Column) -> Column:
    """Non-empty path segments; 0 for what is not a URL."""
    return F.size(segments(url))


def first_segment(url: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit(""))


def language_allowed(url: Column, letters_only: bool = True, ignore_case: bool = True, languages: tuple[str, ...] = ("en", "us"), on_error: bool = True) -> Column:
    """Whether a first path part of two characters, taken as a language, is one of ``languages``. The switches give the four readings in
    use: letters or any characters, with or without case, which languages, and what an unreadable URL counts as."""
    part = first_segment(url)
    code = F.lower(part) if ignore_case else part
    marked = part.rlike("^[A-Za-z]{2}$") if letters_only else F.char_length(part) == 2
    return F.when(host(url) == "", on_error).otherwise(~marked | code.isin(*languages))


def is_valid(url: Column, base: Column | None = None, all_languages: bool = False) -> Column:
    """http(s), of the base's host if a base is given, not an asset, and in an accepted language."""
    ok = scheme(url).isin("http", "https") & (host(url) != "") & ~F.lower(path(url)).rlike(r"\.(" + "|".join(NOT_PAGES) + ")$")
    if base is not None:
        ok = ok & (host(url) == host(base))
    return F.coalesce(ok if all_languages else ok & language_allowed(url, on_error=False), F.lit(False))


def collapse_slashes(url: Column) -> Column:
    """Repeated slashes become one, but for those after the scheme."""
    return F.regexp_replace(F.regexp_replace(url, r"/{2,}", "/"), r"^([A-Za-z][A-Za-z0-9+.-]*:)/", "$1//")


def without_query(url: Column) -> Column:
    """Crawl key of a link: no fragment, no query."""
    return F.regexp_replace(url, r"[?#].*$", "")


def normalize(url: Column) -> Column:
    """Lower-case host, no default port, no final slash, sorted query parameters, single slashes, no fragment."""
    parameters = F.array_join(F.array_sort(F.split(query(url), "&")), "&")
    tail = F.regexp_replace(F.regexp_replace(path(url), r"/{2,}", "/"), r"/$", "")
    return F.when(host(url) == "", url).otherwise(F.concat(origin(url), tail, F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), parameters))))


def image_format(src: Column) -> Column:
    """Known format by extension, 'img unknown' for others, 'unknown' without a source."""
    extension = F.lower(F.substring_index(F.substring_index(src, "?", 1), ".", -1))
    return F.when(F.coalesce(src, F.lit("")) == "", "unknown").when(extension.isin(*IMAGE_FORMATS), extension).otherwise("img unknown")


def content_type(url: Column, status: Column, given: Column) -> Column:
    """Declared type, or for a page that answered 200 without an extension HTML, else by extension, else unknown."""
    extension = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.nullif(given, F.lit("")), F.when((status == 200) & (extension == ""), "text/html"), F.try_element_at(table, extension), F.lit("unknown"))


def link_type(target: Column, source: Column) -> Column:
    bad = (host(target) == "") | (host(source) == "")
    return F.when(F.coalesce(bad, F.lit(True)), "Invalid URL").when(host(target) != host(source), "External").when(F.contains(target, F.lit("#")), "Internal Anchor").otherwise("Internal Page")


def in_navigation(context: Column) -> Column:
    low = F.lower(F.coalesce(context, F.lit("")))
    return F.contains(low, F.lit("nav")) | F.contains(low, F.lit("header"))


def is_sitemap_xml(text: Column) -> Column:
    declared = F.contains(text, F.lit("<?xml")) | F.contains(text, F.lit("http://www.sitemaps.org/schemas/sitemap/"))
    index = F.contains(text, F.lit("<sitemapindex")) & F.contains(text, F.lit("</sitemapindex>"))
    return F.coalesce(declared & ((F.contains(text, F.lit("<urlset")) & F.contains(text, F.lit("</urlset>"))) | index), F.lit(False))


def url_flags(url: Column, base: Column) -> dict[str, Column]:
    """Properties counted per site."""
    return {
        "is_internal": host(url) == host(base),
        "has_non_ascii": url.rlike(r"[^\x00-\x7F]"),
        "has_uppercase": url.rlike("[A-Z]"),
        "has_underscore": F.contains(url, F.lit("_")),
        "has_space": url.rlike(r"\s|%20"),
        "is_long": F.char_length(url) > 115,
    }


def error_class(status: Column, code: Column, message: Column) -> Column:
    """What kind of failure a fetch ended in: challenge, blocked, network or other; null for none."""
    low = F.lower(F.coalesce(message, F.lit("")))
    challenge = status.isin(403, 503) & low.rlike("cloudflare|challenge|just a moment")
    blocked = status.isin(401, 403, 429) | low.rlike("blocked|forbidden|access denied")
    network = F.coalesce(code, F.lit("")).isin("ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "ECONNABORTED", "EAI_AGAIN") | low.rlike("timeout|net::err|socket hang up")
    return F.when(challenge, "challenge").when(blocked, "blocked").when(network, "network").when((status >= 400) | (low != ""), "other")


def cache_key(url: Column) -> Column:
    return F.md5(url)

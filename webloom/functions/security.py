"""Security scores from response headers and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.numbers import points

#: Points of response headers, directives looked for, and patterns of mixed content and risky markup.
HEADER_POINTS = {
    "strict-transport-security": 20,
    "content-security-policy": 20,
    "x-frame-options": 15,
    "x-content-type-options": 15,
    "referrer-policy": 15,
    "permissions-policy": 15,
}
CSP_DIRECTIVES = ("default-src", "script-src", "style-src", "img-src", "connect-src", "form-action", "frame-ancestors")
MIXED_CONTENT = (r"src=[\"']http://", r"href=[\"']http://", r"url\([\"']?http://", r"[@import\s]+[\"']http://")
RISKY_ONCE = (r"(?i)<input[^>]*type=[\"']password[\"'][^>]*>", r"(?i)<form[^>]*>")
RISKY_EACH = (r"onclick=[\"'][^\"']*[\"']", "javascript:void", r"eval\s*\(", r"document\.write\s*\(", r"<a[^>]*target=[\"']_blank[\"'][^>]*>", r"innerHTML\s*=", r"localStorage\.", r"sessionStorage\.")


def header(headers: Column, name: str) -> Column:
    """Value of a header by its lower-case name; an empty one counts as absent."""
    return F.nullif(F.try_element_at(headers, F.lit(name)), F.lit(""))


def header_score(headers: Column) -> Column:
    return points([(header(headers, name).isNotNull(), value) for name, value in HEADER_POINTS.items()])


def mixed_content(html: Column) -> Column:
    """References to plain http: sources, links, styles and imports."""
    total = F.lit(0)
    for pattern in MIXED_CONTENT:
        total = total + F.regexp_count(F.coalesce(html, F.lit("")), F.lit(pattern))
    return total


def cookie_score(cookies: Column) -> Column:
    """100, less for each cookie that lacks an attribute; without cookies 0."""
    each = F.aggregate(
        F.coalesce(cookies, F.array().cast("array<string>")),
        F.lit(100),
        lambda score, c: score
        - F.when(F.contains(c, F.lit("Secure;")), 0).otherwise(20)
        - F.when(F.contains(c, F.lit("HttpOnly;")), 0).otherwise(20)
        - F.when(F.contains(c, F.lit("SameSite=")), 0).otherwise(15)
        - F.when(F.contains(c, F.lit("Expires=")) | F.contains(c, F.lit("Max-Age=")), 0).otherwise(10),
    )
    return F.when(F.coalesce(F.size(cookies), F.lit(0)) <= 0, 0).otherwise(F.greatest(F.lit(0), each))


def csp_score(headers: Column) -> Column:
    csp = header(headers, "content-security-policy")
    minus = F.lit(0)
    for directive in CSP_DIRECTIVES:
        minus = minus + F.when(F.contains(csp, F.lit(directive)), 0).otherwise(100 // len(CSP_DIRECTIVES))
    for word in ("'unsafe-inline'", "'unsafe-eval'"):
        minus = minus + F.when(F.contains(csp, F.lit(word)), 20).otherwise(0)
    return F.when(csp.isNull(), 0).otherwise(F.greatest(F.lit(0), 100 - minus))


def xss_score(headers: Column) -> Column:
    guard, csp = header(headers, "x-xss-protection"), header(headers, "content-security-policy")
    minus = F.when(guard.isNull(), 50).when(guard != "1; mode=block", 25).otherwise(0)
    policy = F.when(csp.isNull(), 25).otherwise(F.when(F.contains(csp, F.lit("script-src")), 0).otherwise(15) + F.when(F.contains(csp, F.lit("'unsafe-inline'")), 15).otherwise(0))
    return F.when(headers.isNull(), 0).otherwise(F.greatest(F.lit(0), 100 - minus - policy))


def certificate_status(valid_to: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_micros(valid_to) - F.unix_micros(as_of)) / 86_400_000_000)
    return F.when(valid_to.isNull(), "No certificate").when(days < 0, "Expired").when(days < 30, "Expiring soon").otherwise("Valid")


def vulnerabilities(html: Column) -> Column:
    """Matches of risky patterns; two of them count once a page."""
    text = F.coalesce(html, F.lit(""))
    total = F.lit(0)
    for pattern in RISKY_ONCE:
        total = total + text.rlike(pattern).cast("int")
    for pattern in RISKY_EACH:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def overall(https: Column, headers: Column, cookies: Column, csp: Column, xss: Column, risky: Column) -> Column:
    """Weighted sum of the parts, 0 to 100."""
    return F.when(https, 30.0).otherwise(0.0) + 0.2 * headers + 0.15 * cookies + 0.15 * csp + 0.1 * xss + 0.1 * F.greatest(F.lit(0), 100 - 10 * risky)

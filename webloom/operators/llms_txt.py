"""llms.txt: structure and quality of files that address language models."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.numbers import grade
from webloom.operators.robots import said

#: Words by which headings count as one of the six sections.
SECTIONS = {
    "access_guidelines": ("access", "guidelines", "rate limit", "usage"),
    "content_restrictions": ("restrictions", "prohibited", "disallow", "off-limits"),
    "api_access": ("api", "endpoint", "authentication"),
    "training_guidelines": ("training", "machine learning", "data usage"),
    "attribution": ("attribution", "credit", "citation"),
    "error_handling": ("error", "retry", "fallback"),
}


def parse(files: DataFrame, key: str = "url", content: str = "content") -> DataFrame:
    """Columns of a file: title, description, contact, last_updated, site_type (the last three also as has_...), headings, outline (level, text and line of each), sections (those but the
    title, with the lines below each), links, word_count, line_count, valid.

    All within the row: a file is an array of lines. A null or blank file is not valid and has nulls and empty arrays."""
    lines = F.transform(F.split("_content", r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    numbered = F.transform("_lines", lambda s, i: F.struct(F.char_length(F.regexp_extract(s, r"^(#+)\s+\S", 1)).alias("level"), F.regexp_replace(s, r"^#+\s+", "").alias("text"), (i + 1).alias("line")))
    first = F.array_position(F.transform("_lines", lambda s: F.startswith(s, F.lit("# "))), F.lit(True))
    # each step is a column of its own, as what stands inside a function of an array is computed anew for every element
    rows = files.select(key, F.coalesce(F.col(content), F.lit("")).alias("_content")).withColumn("_lines", lines)
    rows = rows.withColumns({"outline": F.filter(numbered, lambda h: h["level"] > 0), "_first": first, "_plain": F.filter("_lines", lambda s: ~F.startswith(s, F.lit("#")))})
    rows = rows.withColumns({"_bodies": F.filter("outline", lambda h: h["line"] != F.col("_first")), "_end": F.size("_lines") + 1})
    lines, bodies, at, plain, text = (F.col(c) for c in ("_lines", "_bodies", "_first", "_plain", "_content"))
    headings = F.transform(F.filter(lines, lambda s: s.rlike(r"^#+\s+\S")), lambda s: F.regexp_replace(s, r"^#+\s+", ""))

    def body(h: Column, i: Column) -> Column:
        """Lines that say something from a heading to the next."""
        end = F.coalesce(F.try_element_at(bodies, i + 2)["line"], F.col("_end"))
        return F.filter(F.slice(lines, h["line"] + 1, F.greatest(end - h["line"] - 1, F.lit(0))), lambda s: (s != "") & ~F.startswith(s, F.lit("#")))

    sections = F.transform(bodies, lambda h, i: F.struct(h["text"].alias("heading"), h["level"].alias("level"), h["line"].alias("line"), body(h, i).alias("content")))
    title = F.regexp_extract(F.try_element_at(F.filter(lines, lambda s: F.startswith(s, F.lit("# "))), F.lit(1)), r"^#\s+(.*)$", 1)
    after = F.when(at > 0, F.slice(lines, F.greatest(at, F.lit(1)).cast("int") + 1, F.size(lines)))
    description = F.try_element_at(F.filter(after, lambda s: (F.char_length(s) > 20) & ~F.startswith(s, F.lit("#")) & ~F.startswith(s, F.lit("**"))), F.lit(1))

    def labelled(word: str):
        """Whether a line has the label, and what follows it in the last such line."""
        found = F.filter(plain, lambda s: F.contains(F.lower(s), F.lit(f"{word}:")) | F.contains(F.lower(s), F.lit(f"**{word}**:")))
        values = F.filter(F.transform(found, lambda s: F.regexp_extract(s, rf"(?i){word}[:\s]+(.+)", 1)), lambda v: v != "")
        name = word.replace(" ", "_")
        return (F.size(found) > 0).alias(f"has_{name}"), F.trim(F.try_element_at(values, F.lit(-1))).alias(name)

    links = F.transform(F.regexp_extract_all(text, F.lit(r"(\[[^\]]+\]\([^)]+\))"), F.lit(1)), lambda s: F.struct(F.regexp_extract(s, r"^\[([^\]]+)\]", 1).alias("text"), F.regexp_extract(s, r"\(([^)]+)\)$", 1).alias("url")))
    return rows.select(
        key,
        F.nullif(title, F.lit("")).alias("title"),
        description.alias("description"),
        *labelled("contact"),
        *labelled("last updated"),
        *labelled("site type"),
        headings.alias("headings"),
        "outline",
        sections.alias("sections"),
        links.alias("links"),
        F.regexp_count(text, F.lit(r"\S+")).alias("word_count"),
        F.size(lines).alias("line_count"),
        (text != "").alias("valid"),
        "_content",
    )


def quality(files: DataFrame, key: str = "url", content: str = "content") -> DataFrame:
    """Score (0 to 100), label, counts, and lists of issues and recommendations of every file."""
    p = parse(files, key, content)
    p = p.withColumns({"_low": F.lower("_content"), "_said": F.lower(F.array_join("headings", "\n")), "_links": F.size("links"), "_headings": F.size("headings")})
    low, words, links = F.col("_low"), F.col("word_count"), F.col("_links")

    def present(name: str):
        return F.when(F.coalesce(F.col(name), F.lit("")) != "" if name in ("title", "description") else F.col(f"has_{name}"), 10).otherwise(0)

    def has_section(name: str):
        return F.col(f"_{name}")

    n_sections = F.col("_sections")
    hits = (
        (F.contains(low, F.lit("rate")) & (F.contains("_content", F.lit("per hour")) | F.contains("_content", F.lit("per minute")))).cast("int")
        + (F.contains(low, F.lit("endpoint")) | F.contains(low, F.lit("api/"))).cast("int")
        + (F.contains("_content", F.lit("/")) & (F.contains("_content", F.lit("admin")) | F.contains("_content", F.lit("api")))).cast("int")
    )
    p = p.withColumns({"_hits": hits, **{f"_{name}": reduce(or_, (F.contains("_said", F.lit(w)) for w in words_)) for name, words_ in SECTIONS.items()}})
    p, hits = p.withColumn("_sections", sum((F.when(has_section(name), 5).otherwise(0) for name in SECTIONS), F.lit(0))), F.col("_hits")
    total = (
        present("title") + present("description") + present("contact") + present("last_updated") + n_sections
        + F.when(words >= 200, 15).when(words >= 100, 10).when(words >= 50, 5).otherwise(0)
        + F.when(links >= 5, 10).when(links >= 3, 7).when(links >= 1, 4).otherwise(0)
        + F.when(hits >= 2, 5).when(hits == 1, 3).otherwise(0)
        + F.when(F.col("has_site_type"), 3).otherwise(0)
        + F.when(F.col("_headings") >= 5, 2).otherwise(0)
    )
    p, score = p.withColumn("_score", F.when(F.col("valid"), F.least(F.lit(100), total)).otherwise(0)), F.col("_score")
    label = F.when(~F.col("valid"), "Missing").otherwise(grade(score, [(85, "Excellent"), (70, "Good"), (50, "Fair"), (30, "Poor")], "Very Poor"))
    # what is said of a file
    core = {
        "title": ("The site is not named in a first heading", "Begin with a heading that names the site"),
        "description": ("What the site is for is not said", "Say in a sentence or two what the site is for"),
        "contact": ("Nobody is named to ask", "Name an address for questions on access"),
        "last_updated": ('The date of the last change is not given', "Give the date of the last change"),
    }
    issues = said(
        ~F.col("valid"),
        "There is no llms.txt, or it has no heading",
        *((present(c) == 0, text) for c, (text, _) in core.items()),
        (words < 50, "The text has fewer than 50 words"),
        (links == 0, "Nothing is linked"),
    )
    advice = said(
        ~F.col("valid"),
        "Publish an llms.txt that begins with a heading",
        *((present(c) == 0, text) for c, (_, text) in core.items()),
        *((~has_section(name), f"Write a section on {name.replace('_', ' ')}") for name in SECTIONS),
        (words.between(100, 199), F.format_string("Go into more detail than %d words allow", words)),
        (words.between(50, 99), "Write the sections out"),
        (links.between(3, 4), "Link to a few more documents"),
        (links.between(1, 2), "Link to the documents that matter most"),
        (links == 0, "Link to documents on interfaces and rules"),
        (hits == 1, "Name one more fact that programs need, such as limits or paths"),
        (hits == 0, "Name the facts that programs need: limits, addresses, closed paths"),
        (~F.col("has_site_type"), "Say what type of site it is"),
    )
    core_elements = sum((F.when(present(c) > 0, 1).otherwise(0) for c in core), F.lit(0))
    length = F.when(~F.col("valid"), "Unknown").when(words >= 200, "Comprehensive").when(words >= 100, "Adequate").when(words >= 50, "Minimal").otherwise("Insufficient")
    more = {
        "exists": F.col("valid"), "max_score": F.lit(100), "has_title": F.col("title").isNotNull(), "title": F.col("title"), "has_description": F.col("description").isNotNull(), "has_contact": F.col("has_contact"), "contact": F.col("contact"), "has_last_updated": F.col("has_last_updated"), "last_updated": F.col("last_updated"),
        "has_site_type": F.col("has_site_type"), "site_type": F.col("site_type"), "core_elements": core_elements, "core_total": F.lit(len(core)), "sections_total": F.lit(len(SECTIONS)), "line_count": F.col("line_count"), "length": length,
        "specificity": F.when(~F.col("valid"), "Unknown").when(hits >= 2, "High").when(hits == 1, "Medium").otherwise("Low"), "structured": F.col("valid") & (words >= 200),
    }
    counts = [*[v.alias(k) for k, v in more.items()], (n_sections / 5).cast("int").alias("sections"), F.col("word_count"), links.alias("n_links"), F.col("_headings").alias("n_headings")]
    return p.select(key, score.cast("int").alias("score"), label.alias("quality"), *counts, issues.alias("issues"), advice.alias("recommendations"))

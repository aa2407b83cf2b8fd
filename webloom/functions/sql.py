"""The scorers under SQL names, for use in spark.sql: expressions as SQL functions, the structural pass as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

from webloom.session import ship

#: Name, parameters, result and body of the SQL functions; Catalyst inlines them, so they cost what their expression costs.
SCALARS = [
    ("wl_ramp", "v DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "coalesce(least(1D, greatest(0D, (v - low) / (high - low))), 0D)"),
    ("wl_half_up", "v DOUBLE", "BIGINT", "floor(v + 0.5)"),
    ("wl_percent_change", "o DOUBLE, n DOUBLE", "DOUBLE", "CASE WHEN o = 0 THEN CASE WHEN n = 0 THEN 0D ELSE 100D END ELSE (n - o) / nullif(o, 0D) * 100 END"),
    ("wl_host", "url STRING", "STRING", r"lower(regexp_extract(url, r'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"),
    ("wl_link_depth", "url STRING", "INT", r"size(filter(split(regexp_extract(url, r'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), s -> s <> ''))"),
    ("wl_syllables", "word STRING", "INT", "regexp_count(lower(word), '[aeiouy]{1,2}')"),
    ("wl_word_count", "text STRING", "INT", r"size(split(regexp_replace(text, r'^\s+|\s+$', ''), r'\s+'))"),
    ("wl_title_score", "title STRING", "DOUBLE", "CASE WHEN char_length(title) > 0 THEN least(1D, greatest(0D, (char_length(title) - 30) / 30D)) ELSE 0D END"),
]


class ExtractPage:
    """One row of headline metrics per page."""

    def eval(self, html: str, url: str):
        from webloom.operators.extract import features

        f = features(html, url, None)
        yield f["title"], f["h1"], f["html_lang"], f["word_count"], len(f["links"]), len(f["images"]), f["has_schema_org"], f["name_ratio"]


def page_fields(spark: SparkSession) -> type:
    """The structural pass as a table function: ``wl_page_fields(TABLE(pages), 'title, n_internal')`` has the url and those fields of each page of a table with url and html; with a third
    argument, a column's name, the rows of one of its values come together. The result's columns follow from the fields asked for; an unknown field is an error when the
    query is analysed."""
    from webloom.operators.extract import FEATURES

    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(FEATURES).fields}

    class PageFields:
        @staticmethod
        def analyze(pages: AnalyzeArgument, fields: AnalyzeArgument, by: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not pages.isTable or not {"url", "html"} <= set(pages.dataType.names):
                raise ValueError("the first argument is a table with columns url and html")
            if not fields.isConstantExpression or not isinstance(fields.value, str):
                raise ValueError("the second argument is a constant list of fields")
            names = [n.strip() for n in fields.value.split(",") if n.strip()]
            if unknown := [n for n in names if n not in kinds]:
                raise ValueError(f"no field {', '.join(unknown)}")
            schema = T.StructType([T.StructField("url", pages.dataType["url"].dataType), *(T.StructField(n, kinds[n]) for n in names)])
            together = [PartitioningColumn(by.value)] if by is not None and by.value else []
            columns = [SelectedColumn("url"), SelectedColumn("html"), *(SelectedColumn(by.value) for _ in together if by.value not in ("url", "html"))]
            return AnalyzeResult(schema=schema, partitionBy=together, select=columns)

        def eval(self, page: T.Row, fields: str, by: str | None = None):
            from webloom.operators.extract import guarded

            found = guarded(page["html"], page["url"], None)
            yield (page["url"], *(found[n.strip()] for n in fields.split(",") if n.strip()))

    return PageFields


def register(spark: SparkSession) -> None:
    """Create temporary functions wl_… and the table functions wl_extract_page(html, url) and wl_page_fields(TABLE(...), fields) in a session."""
    ship(spark)
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    columns = "title string, h1 string, html_lang string, words int, links int, images int, has_schema_org boolean, name_ratio double"
    spark.udtf.register("wl_extract_page", udtf(ExtractPage, returnType=columns))
    spark.udtf.register("wl_page_fields", udtf(page_fields(spark)))

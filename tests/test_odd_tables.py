"""Queries against their SQL on rows that the stored tables lack."""

import duckdb
import pytest

from tests.test_queries import rows_of
from webloom.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query and its SQL give the same rows on a table."""

    def check(name, table, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        found, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows_of(found) == rows_of(want)
        return found

    return check


PAGES = "page_id bigint, url string, html string"


def page(title, h1="", rest=""):
    return f'<html lang="en"><head><title>{title}</title></head><body><h1>{h1}</h1>{rest}</body></html>'


def test_main_keyword_of_pages_without_words(same):
    html = [page("É É", "É É"), page("", ""), None, page("", "one two two"), page("É", "- a -")]
    assert len(same("main_keyword", "pages", PAGES, [(k, f"https://a.com/{k}", h) for k, h in enumerate(html)])) == 2


def test_page_structure_of_references(same):
    titles = ["a &amp; b", "&quot;a&quot;", "cut &am", "&lt;b&gt; &amp;amp;", "a  b", "&#228;&nbsp;x"]
    same("page_structure", "pages", PAGES, [(k, f"https://a.com/{k}", page(t, t, f"<p>{t}</p><a href='/x'>x</a>")) for k, t in enumerate(titles)])


def test_robots_by_site_of_repeated_addresses(same):
    """One address is several pages, whose sites have different rules; one is none of theirs."""
    same("robots_by_site", "pages", PAGES, [(k, f"https://a.com/{k % 7}" if k % 5 else None, "") for k in range(120)])


def test_scores_at_a_half(same):
    """Points whose sum is at a half of a percent, but beside it where tenths are summed as binary fractions."""
    rest = "<h2></h2>" + '<a href="/x"></a>' * 20
    rows = [(609741 + k - k % 2, f"https://a/{k % 2}", page("É" * 29, "É", f"<p>{'w ' * (1109 + k // 2)}</p>{rest}")) for k in range(-6, 8)]
    same("seo_component_scores", "pages", PAGES, [(n + 9000 * k, *r) for k, (n, *r) in enumerate(rows)])


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_robots_quality_stays_within_the_row(spark, small):
    """No task gathers more than a row, however many files there are."""
    assert "Exchange" not in executed(QUERIES["robots_quality"](spark, small))


def test_llms_txt_quality_splits_a_file_once(spark, small):
    """Each step is computed once a row, not anew for all that is made of it."""
    assert executed(QUERIES["llms_txt_quality"](spark, small)).count("split(") == 1

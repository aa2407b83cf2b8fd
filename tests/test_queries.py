"""Every query with SQL gives the same rows in a second engine."""

import duckdb
import pytest

import __spark_entry__ as entry
from webloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def shown(value):
    if value is None or value != value:
        return "~"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(shown(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, duck, name):
    found = QUERIES[name](spark, small).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found) == rows_of(want)


def test_accessibility_summary_counts_every_issue(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    found = QUERIES["accessibility_summary"](spark, small).first()
    assert found["errors"] + found["warnings"] + found["notices"] == events.count()
    assert found["per_page"] == pytest.approx(events.count() / events.select("user_id").distinct().count(), abs=0.051)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_known_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

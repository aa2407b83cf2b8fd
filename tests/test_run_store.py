"""Stored runs: idempotent writing, pruned reading, pins, and the run that was current at a time."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webloom.sources.run_store import RunStore

KIND = "run_id string, run_ts timestamp, site string, family string, metric string, value double"


def runs(spark, *rows):
    return spark.createDataFrame([(i, datetime(2024, 1, d), s, "f", m, v) for i, d, s, m, v in rows], KIND)


@pytest.fixture
def store(spark, tmp_path):
    out = RunStore(spark, str(tmp_path / "runs"))
    out.write(runs(spark, ("r1", 1, "a", "load_time", 100.0), ("r1", 1, "b", "load_time", 100.0), ("r2", 5, "a", "load_time", 300.0), ("r2", 5, "b", "load_time", 90.0), ("r2", 5, "a", "seo_score", 80.0), ("r3", 9, "a", "load_time", 310.0), ("r3", 9, "a", "seo_score", 60.0)))
    return out


def test_storing_a_run_again_replaces_it(spark, store):
    before = store.metrics().count()
    store.write(runs(spark, ("r2", 5, "a", "load_time", 333.0)))
    found = {(r["run"], r["site"], r["metric"]): r["value"] for r in store.metrics().collect()}
    assert len(found) == before - 2 and found["20240105T000000-r2", "a", "load_time"] == 333.0


def test_only_asked_runs_are_read(store):
    rows = store.metrics(["20240105T000000-r2"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan or "PartitionFilters: [(run" in plan
    assert len(rows.inputFiles()) < len(store.metrics().inputFiles()) or rows.count() == 3


def test_latest_run_not_after_a_time(spark, store):
    times = spark.createDataFrame([("a", datetime(2024, 1, d), n) for d, n in ((1, "at"), (4, "between"), (20, "after"))] + [("a", datetime(2023, 1, 1), "before"), ("b", datetime(2024, 1, 20), "b"), ("x", datetime(2024, 1, 20), "none"), ("a", None, "null")], "site string, at timestamp, name string")
    found = {r["name"]: r["run"] for r in store.as_of(times).collect()}
    assert found == {"at": "20240101T000000-r1", "between": "20240101T000000-r1", "after": "20240109T000000-r3", "before": None, "b": "20240105T000000-r2", "none": None, "null": None}
    plan = store.as_of(times)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_regressions_against_the_pinned_run(spark, store):
    assert store.baseline() is None and store.regressions("20240109T000000-r3").count() == 0
    store.pin(run="20240101T000000-r1", at=F.lit("2024-02-01"))
    found = {(r["site"], r["metric"]): (r["old"], r["new"], r["severity"]) for r in store.regressions("20240109T000000-r3").collect()}
    assert found == {("a", "load_time"): (100.0, 310.0, "critical")}  # against the run before it would be none
    store.pin(run="20240105T000000-r2", site="a", at=F.lit("2024-02-02"))
    found = {(r["site"], r["metric"]): r["severity"] for r in store.regressions("20240109T000000-r3").collect()}
    assert found == {("a", "seo_score"): "critical"}
    assert {r["site"]: r["value"] for r in store.baseline().filter("metric = 'load_time'").collect()} == {"a": 300.0, "b": 100.0}
    assert store.pin(site="b", at=F.lit("2024-02-03")) == "20240105T000000-r2"


def test_pins_of_no_run_and_other_versions(spark, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path / "none"))
    assert store.metrics().count() == 0 and store.pins().count() == 0
    with pytest.raises(ValueError, match="no run to take"):
        store.pin()
    monkeypatch.setattr("webloom.schemas.SCHEMA_VERSION", "0.9.0")
    store.write(runs(spark, ("r1", 1, "a", "load_time", 1.0)))
    assert store.metrics().count() == 0
    with pytest.raises(ValueError, match="no run 2024"):
        store.pin(run="20240101T000000-r1")

"""Runs over time: long metric tables, comparison with the run before or a baseline, trends and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.numbers import percent_change

#: Regression rules: metric, what is compared, and limits of the two severities (a fall counts from negative limits on).
RULES = [
    ("load_time", "percent", 30.0, 15.0),
    ("lcp", "percent", 30.0, 15.0),
    ("fcp", "percent", 30.0, 15.0),
    ("tti", "percent", 30.0, 15.0),
    ("tbt", "percent", 30.0, 15.0),
    ("cls", "percent", 50.0, 25.0),
    ("a11y_errors", "delta", 0.0, None),
    ("a11y_total", "delta", None, 10.0),
    ("seo_score", "percent", -10.0, -5.0),
    ("served_score", "percent", -10.0, -5.0),
    ("rendered_score", "percent", None, -10.0),
]


def run_metrics(rows: DataFrame, keys: list[str], metrics: dict[str, object]) -> DataFrame:
    """Long table (keys, metric, value) from one aggregation per run; averages count nulls as 0 where the expression says so."""
    wide = rows.groupBy(*keys).agg(*[e.cast("double").alias(name) for name, e in metrics.items()])
    return wide.unpivot([F.col(k) for k in keys], [F.col(m) for m in metrics], "metric", "value")


def _own(metrics: DataFrame) -> list[str]:
    """What tells series apart: the site, where there is one, and the metric."""
    return [c for c in ("site", "metric") if c in metrics.columns]


def compare_previous(metrics: DataFrame) -> DataFrame:
    """Every metric of every run (of a site) but the first with the run before: old, new, delta, percent."""
    before = Window.partitionBy(*_own(metrics)).orderBy("run_ts")
    return compared(metrics.withColumn("old", F.lag("value").over(before)).filter("old is not null").withColumnRenamed("value", "new"))


def compare_baseline(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every metric of every run with a pinned run's (metric, value), of the same site where both have sites."""
    own = [c for c in _own(metrics) if c in baseline.columns]
    return compared(metrics.withColumnRenamed("value", "new").join(baseline.select(*own, F.col("value").alias("old")), own))


def compared(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"delta": F.col("new") - F.col("old"), "percent": percent_change(F.col("old"), F.col("new"))})


def establish_baseline(metrics: DataFrame, run_ts=None) -> DataFrame:
    """Metrics of the run at ``run_ts`` or of the latest; fails if there is none."""
    latest = metrics.agg(F.max("run_ts").alias("t")).first()["t"] if run_ts is None else run_ts
    found = metrics.filter(F.col("run_ts") == F.lit(latest))
    if latest is None or found.isEmpty():
        raise ValueError("no run to take as baseline")
    return found


def regressions(comparison: DataFrame) -> DataFrame:
    """Rows of a comparison that break a rule, with severity: critical, warning, or info for a changed number of URLs."""
    severity = F.lit(None).cast("string")
    for metric, what, critical, warning in RULES:
        value, hit = F.col(what), F.col("metric") == metric
        for limit, name in ((warning, "warning"), (critical, "critical")):
            if limit is not None:
                over = value < limit if limit < 0 else value > limit
                severity = F.when(hit & over, name).otherwise(severity)
    severity = F.when((F.col("metric") == "url_count") & (F.abs("delta") > 0.2 * F.col("old")), "info").otherwise(severity)
    return comparison.withColumn("severity", severity).filter("severity is not null")


def trends(metrics: DataFrame) -> DataFrame:
    """Each metric's values (of a site) in order of runs; none with fewer than two runs."""
    ordered = F.array_sort(F.collect_list(F.struct("run_ts", "value")))
    own = _own(metrics)
    return metrics.groupBy(*own).agg(ordered.alias("_s")).filter(F.size("_s") >= 2).select(*own, F.col("_s.run_ts").alias("run_ts"), F.col("_s.value").alias("values"))


def change_summary(comparison: DataFrame) -> DataFrame:
    """Improved, worse or stable, for load time (5 %), issues (any) and SEO (2 points)."""
    m, d, p = F.col("metric"), F.col("delta"), F.col("percent")
    verdict = (
        F.when(m == "load_time", F.when(p < -5, "improved").when(p > 5, "worse").otherwise("stable"))
        .when(m == "a11y_total", F.when(d < 0, "improved").when(d > 0, "worse").otherwise("stable"))
        .when(m == "seo_score", F.when(d > 2, "improved").when(d < -2, "worse").otherwise("stable"))
    )
    return comparison.withColumn("verdict", verdict).filter("verdict is not null")

"""Queries over runs: days of events stand for runs of an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import history
from webloom.plans.page_queries import long, six
from webloom.plans.registry import register
from webloom.sources.tables import table


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of daily measures under the names of audit metrics."""
    rows = table(spark, sf_dir, "events").withColumn("run_ts", F.date_format("ts", "yyyy-MM-dd"))
    v, kind = F.col("value"), F.col("event_type")
    return history.run_metrics(
        rows,
        ["run_ts"],
        {
            "load_time": F.avg(F.coalesce(F.when(kind == "view", v), F.lit(0.0))),
            "cls": F.max(v) / 1000,
            "a11y_errors": F.count_if(kind == "error"),
            "a11y_total": F.count_if(kind.isin("error", "click")),
            "seo_score": F.avg(F.when(kind == "purchase", v)),
            "url_count": F.count_distinct("user_id"),
        },
    )


SQL_METRICS = """
d AS (SELECT strftime(ts, '%Y-%m-%d') AS run_ts, avg(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS load_time, max(value) / 1000 AS cls, (count(*) FILTER (event_type = 'error'))::DOUBLE AS a11y_errors, (count(*) FILTER (event_type IN ('error', 'click')))::DOUBLE AS a11y_total,
      avg(value) FILTER (event_type = 'purchase') AS seo_score, count(DISTINCT user_id)::DOUBLE AS url_count FROM events GROUP BY 1),
m AS (UNPIVOT d ON load_time, cls, a11y_errors, a11y_total, seo_score, url_count INTO NAME metric VALUE value),
p AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY run_ts) AS old FROM m),
c AS (SELECT run_ts, metric, old, value AS new, value - old AS delta, CASE WHEN old = 0 THEN CASE WHEN value = 0 THEN 0 ELSE 100 END ELSE (value - old) / nullif(old, 0) * 100 END AS percent FROM p WHERE old IS NOT NULL)"""

ROUNDED = ", ".join(f"round({x}, 6) AS {x}" for x in ("old", "new", "delta", "percent"))


@register(f"WITH {SQL_METRICS} SELECT run_ts, metric, round(value, 6) AS value FROM m")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("run_ts", "metric", six(F.col("value")).alias("value"))


@register(f"WITH {SQL_METRICS} SELECT run_ts, metric, {ROUNDED} FROM c")
def compare_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.compare_previous(_metrics(spark, sf_dir))
    return found.select("run_ts", "metric", *[six(F.col(x)).alias(x) for x in ("old", "new", "delta", "percent")])


SQL_SEVERITY = """CASE WHEN metric = 'url_count' AND abs(delta) > 0.2 * old THEN 'info' WHEN metric = 'load_time' THEN CASE WHEN percent > 30 THEN 'critical' WHEN percent > 15 THEN 'warning' END WHEN metric = 'cls' THEN CASE WHEN percent > 50 THEN 'critical' WHEN percent > 25 THEN 'warning' END
 WHEN metric = 'a11y_errors' AND delta > 0 THEN 'critical' WHEN metric = 'a11y_total' AND delta > 10 THEN 'warning' WHEN metric = 'seo_score' THEN CASE WHEN percent < -10 THEN 'critical' WHEN percent < -5 THEN 'warning' END END"""


@register(f"WITH {SQL_METRICS}, s AS (SELECT *, {SQL_SEVERITY} AS severity FROM c) SELECT run_ts, metric, severity, round(percent, 6) AS percent FROM s WHERE severity IS NOT NULL")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.regressions(history.compare_previous(_metrics(spark, sf_dir)))
    return found.select("run_ts", "metric", "severity", six(F.col("percent")).alias("percent"))


@register(f"""WITH {SQL_METRICS}, b AS (SELECT metric, value AS old FROM m WHERE run_ts = (SELECT max(run_ts) FROM m)) SELECT run_ts, metric, round(value - old, 6) AS delta FROM m JOIN b USING (metric)""")
def compare_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _metrics(spark, sf_dir)
    found = history.compare_baseline(metrics, history.establish_baseline(metrics))
    return found.select("run_ts", "metric", six(F.col("delta")).alias("delta"))


@register(f"""WITH {SQL_METRICS}, v AS (SELECT run_ts, metric, CASE metric WHEN 'load_time' THEN CASE WHEN percent < -5 THEN 'improved' WHEN percent > 5 THEN 'worse' ELSE 'stable' END WHEN 'a11y_total' THEN CASE WHEN delta < 0 THEN 'improved' WHEN delta > 0 THEN 'worse' ELSE 'stable' END
 WHEN 'seo_score' THEN CASE WHEN delta > 2 THEN 'improved' WHEN delta < -2 THEN 'worse' ELSE 'stable' END END AS verdict FROM c) SELECT * FROM v WHERE verdict IS NOT NULL""")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.change_summary(history.compare_previous(_metrics(spark, sf_dir))).select("run_ts", "metric", "verdict")


@register(f"WITH {SQL_METRICS} SELECT metric, count(*) AS runs, round(arg_min(value, run_ts), 6) AS first, round(arg_max(value, run_ts), 6) AS last FROM m GROUP BY metric HAVING count(*) >= 2")
def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.trends(_metrics(spark, sf_dir))
    return found.select("metric", long(F.size("values")).alias("runs"), six(F.element_at("values", 1)).alias("first"), six(F.element_at("values", -1)).alias("last"))

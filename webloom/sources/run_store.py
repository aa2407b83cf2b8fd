"""Stored runs: one partition a run, a pinned baseline by site, and the run that was current at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom import schemas
from webloom.operators import history
from webloom.sources.tables import compatible

#: Columns of pins: which run a site's are compared with ('' for all sites that have no pin of their own).
PINS = "site string, run string, pinned_at timestamp"


def run_key(run_ts: Column, run_id: Column) -> Column:
    """Name of a run's partition; names sort by time."""
    return F.concat(F.date_format(run_ts, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.coalesce(run_id, F.lit("")))


class RunStore:
    """Metrics of runs (rows of RUN_METRICS) below a folder.

    A run is a partition, so storing it again replaces it, and what reads some runs lists and opens their files alone. Runs of another major or minor version of the schema are
    not read. Pins are only added; a site's latest is valid."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def write(self, metrics: DataFrame) -> None:
        """Store the runs that ``metrics`` has, each in place of what was stored of it before."""
        rows = metrics.select(*[c.split()[0] for c in schemas.RUN_METRICS.split(", ")]).fillna("", ["site"])
        rows = rows.withColumns({"schema_version": F.lit(schemas.SCHEMA_VERSION), "run": run_key(F.col("run_ts"), F.col("run_id"))})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{self.path}/runs")

    def metrics(self, runs: list[str] | None = None) -> DataFrame:
        """Rows of RUN_METRICS with ``run``: of all runs, or of those named, whose partitions alone are read."""
        rows = self._read("runs", f"{schemas.RUN_METRICS}, schema_version string, run string")
        if runs is not None:
            rows = rows.filter(F.col("run").isin(runs))
        return rows.filter(compatible(F.col("schema_version"))).drop("schema_version")

    def runs(self) -> DataFrame:
        """(run, run_id, run_ts, site): which sites each run has."""
        return self.metrics().select("run", "run_id", "run_ts", "site").distinct()

    def as_of(self, times: DataFrame) -> DataFrame:
        """``times`` (site, at) with run and run_ts of the latest run of the site that is not after ``at``; null where there is none. Runs and times are merged in one sort
        by site and time, so no pair of them is made."""
        runs = self.runs().groupBy("site", "run_ts").agg(F.max("run").alias("run"))
        columns = [c for c in times.columns if c not in ("site", "at")]
        marks = runs.select("site", F.col("run_ts").alias("at"), F.struct("run", "run_ts").alias("_run"), F.lit(0).alias("_kind"), *[F.lit(None).cast(times.schema[c].dataType).alias(c) for c in columns])
        asked = times.select("site", F.col("at").cast("timestamp").alias("at"), F.lit(None).cast("struct<run:string,run_ts:timestamp>").alias("_run"), F.lit(1).alias("_kind"), *columns)
        upto = Window.partitionBy("site").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = marks.unionByName(asked).withColumn("_last", F.last("_run", ignorenulls=True).over(upto)).filter("_kind = 1")
        return found.select("site", "at", *columns, F.col("_last.run").alias("run"), F.col("_last.run_ts").alias("run_ts"))

    def pin(self, at: Column | None = None, run: str | None = None, site: str = "") -> str:
        """Make a run (by default the latest) the one that later runs of a site, or of all, are compared with. Returns its name; fails if there is no such run."""
        rows = self.metrics() if run is None else self.metrics([run])
        if site:
            rows = rows.filter(F.col("site") == site)
        found = rows.agg(F.max("run")).first()[0]
        if found is None:
            raise ValueError("no run to take as baseline" if run is None else f"no run {run}")
        row = self.spark.range(1).select(F.lit(site).alias("site"), F.lit(found).alias("run"), (F.current_timestamp() if at is None else at).cast("timestamp").alias("pinned_at"))
        row.write.mode("append").parquet(f"{self.path}/pins")
        return found

    def pins(self) -> DataFrame:
        """(site, run): the valid pin of each site that has one."""
        return self._read("pins", PINS).groupBy("site").agg(F.max_by("run", F.struct("pinned_at", "run")).alias("run"))

    def baseline(self) -> DataFrame | None:
        """(site, metric, value) of the pinned run of each site: its own pin's, else that for all; None where nothing is pinned. Only pinned runs are read; their names are as
        many as runs that were ever pinned."""
        pins = self.pins()
        named = sorted(r[0] for r in pins.select("run").distinct().collect())
        if not named:
            return None
        rows = self.metrics(named).select("run", "site", "metric", "value")
        own = rows.join(pins, ["site", "run"])
        common = rows.join(pins.filter("site = ''").select("run"), "run").join(pins.select("site"), "site", "left_anti")
        return own.unionByName(common.select(*own.columns)).drop("run")

    def regressions(self, run: str) -> DataFrame:
        """What of a run is worse than the pinned baseline, with severity; no rows where nothing is pinned."""
        baseline = self.baseline()
        rows = self.metrics([run])
        if baseline is None:
            baseline = rows.select("site", "metric", "value").limit(0)
        return history.regressions(history.compare_baseline(rows, baseline))

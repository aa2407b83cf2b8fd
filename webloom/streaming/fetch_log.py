"""Fetch logs as streams: status rates in event-time windows, and the rate limiter as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators.flow import advance
from webloom.session import ship


def status_rates(fetches: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts", status: str = "status") -> DataFrame:
    """Per window of event time: fetches, errors (status 400 and over), error rate. Rows later than ``late`` behind the newest are dropped
    by the watermark, which also bounds the state. Works on batch and streaming input alike."""
    rows = fetches.withWatermark(ts, late) if fetches.isStreaming else fetches
    counts = rows.groupBy(F.window(ts, window).alias("_w")).agg(F.count(F.lit(1)).alias("fetches"), F.count_if(F.col(status) >= 400).alias("errors"))
    return counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "fetches", "errors", (F.col("errors") / F.col("fetches")).alias("error_rate"))


def sessions(fetches: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "host") -> DataFrame:
    """Bursts of fetches per key with at most ``gap`` between neighbours: start, end and number."""
    rows = fetches.withWatermark(ts, late) if fetches.isStreaming else fetches
    found = rows.groupBy(F.session_window(ts, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("fetches"))
    return found.select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "fetches")


def rate_limits(fetches: DataFrame, initial: int = 3, key: str = "host", order: str = "ts", status: str = "status") -> DataFrame:
    """Stream of (host, fetches, concurrency, pause): a host's state after each micro-batch that has responses of it. State per host is four numbers and a count."""
    ship(fetches.sparkSession)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, *now = state.get if state.exists else (0, initial, 0.0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for s in rows[status]:
            now = advance(tuple(now), int(s), initial)
        state.update((seen + len(rows), int(now[0]), float(now[1]), int(now[2]), int(now[3])))
        yield pd.DataFrame({"host": [group[0]], "fetches": [seen + len(rows)], "concurrency": [int(now[0])], "pause": [float(now[1])]})

    narrow = fetches.select(F.col(key).cast("string").alias("host"), order, status)
    return narrow.groupBy("host").applyInPandasWithState(
        run, "host string, fetches bigint, concurrency int, pause double", "seen bigint, concurrency int, pause double, errors int, successes int", "update", GroupStateTimeout.NoTimeout
    )

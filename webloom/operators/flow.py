"""Adaptive rate limiting as a fold over each host's fetches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import ship

#: Errors and successes in a row that change the concurrency, first and longest pause in seconds, and what a pause grows and shrinks by.
ERRORS, SUCCESSES, FIRST_PAUSE, LONGEST_PAUSE, FACTOR = 2, 10, 1.0, 60.0, 2.0

#: Concurrency, pause, errors and successes in a row.
State = tuple[int, float, int, int]


def advance(state: State, status: int, initial: int) -> State:
    """State after one response: 429 and 503 count as errors, 2xx as successes, others change nothing. Enough successes at the initial
    concurrency only start their count anew; below it, they give back one place and shorten the pause."""
    concurrency, pause, errors, successes = state
    if status in (429, 503):
        errors, successes = errors + 1, 0
        if errors >= ERRORS:
            concurrency, pause, errors = max(1, concurrency - 1), FIRST_PAUSE if pause == 0 else min(LONGEST_PAUSE, pause * FACTOR), 0
    elif 200 <= status < 300:
        errors, successes = 0, successes + 1
        if successes >= SUCCESSES:
            successes = 0
            if concurrency < initial:
                concurrency, pause = concurrency + 1, pause / FACTOR
    return concurrency, pause, errors, successes


def replay(fetches: DataFrame, key: str, order: str, status: str, initial: int = 3) -> DataFrame:
    """(key, fetches, concurrency, pause) after all of each key's responses in order. A null status changes nothing; a null key is a key.

    The fold is sequential within a key by nature; a task goes through the sorted rows of its keys and holds one state, so a host's log is
    never gathered in a row or a group."""
    ship(fetches.sparkSession)
    kind = fetches.schema[key].dataType.simpleString()
    rows = fetches.select(F.col(key).alias("_key"), F.col(status).cast("int").alias("_status"), F.col(order).alias("_order"))
    rows = rows.repartition("_key").sortWithinPartitions("_key", "_order").select("_key", "_status")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, own, n, state, type_ = False, None, 0, (initial, 0.0, 0, 0), pa.null()

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (type_, pa.int32(), pa.int32(), pa.float64()), strict=True)], names=[key, "fetches", "concurrency", "pause"])

        for batch in batches:
            type_, done = batch.schema.field(0).type, []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or k != own:
                    if started:
                        done.append((own, n, state[0], state[1]))
                    started, own, n, state = True, k, 0, (initial, 0.0, 0, 0)
                n += 1
                state = advance(state, s or 0, initial)
            if done:
                yield out(done)
        if started:
            yield out([(own, n, state[0], state[1])])

    return rows.mapInArrow(run, f"`{key}` {kind}, fetches int, concurrency int, pause double")

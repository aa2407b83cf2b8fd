"""Packing documents into few windows: best-fit-decreasing within partitions, whose counts lower bounds certify, and exchange between partitions with gaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import releasing
from webloom.llm.packing import best_fit_decreasing
from webloom.llm.tokens import word_encoder
from webloom.session import ship
from webloom.storage import discard, materialize

#: Ids of a block that is packed at once, pieces that a block or group hands on in an exchange, and groups that meet in one task.
BLOCK_IDS, HANDED_ON, FAN_IN = 1 << 22, 8192, 16

#: A certified block, where only the rounding up of its own bound is left, hands on this share of what one with a gap does.
CERTIFIED = 4

#: Rounding functions tried by the bound, of the family u^(k).
ROUNDINGS = 64


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def lower_bound(counts: np.ndarray, capacity: int, enough: int | None = None) -> int:
    """Windows of ``capacity`` that no packing of ``counts[size]`` pieces can do without, by dual feasible functions (each maps sizes so that what fits in a
    window still does; the sum of what pieces map to, over a window's, is a bound). Tried are the sizes themselves; large sizes up to a window with small ones as nothing; rounding
    to multiples of 1 / (k + 1); and rounding of what a large size leaves. Stops early where ``enough`` is reached, as no bound exceeds a packing."""
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    c = counts[sizes].astype(np.int64)
    best = _ceil(int((sizes * c).sum()), capacity)
    if enough is not None and best >= enough:
        return best

    total, number = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    np.cumsum(np.bincount(sizes, sizes * c, capacity + 1).astype(np.int64), out=total[1:])
    np.cumsum(np.bincount(sizes, c, capacity + 1).astype(np.int64), out=number[1:])
    small = np.arange(1, capacity // 2 + 1)
    sums = (number[-1] - number[capacity - small + 1]) * capacity + total[capacity - small + 1] - total[small]
    best = max(best, int(-(-sums.max(initial=0) // capacity)))
    if enough is not None and best >= enough:
        return best

    for k in range(1, ROUNDINGS + 1):
        up = (k + 1) * sizes
        value = np.where(up % capacity == 0, k * sizes, up // capacity * capacity)
        best = max(best, _ceil(int((value * c).sum()), k * capacity))
    k = small[:, None]
    whole = capacity // k
    for at in range(0, len(small), 256):
        step, full = k[at : at + 256], whole[at : at + 256]
        value = np.where(2 * sizes > capacity, 2 * (full - (capacity - sizes) // step), np.where(2 * sizes == capacity, full, 2 * (sizes // step)))
        best = max(best, int((-(-(value * c).sum(axis=1) // (2 * full[:, 0]))).max()))
        if enough is not None and best >= enough:
            break
    return best


def histogram(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Pieces of each size up to ``capacity``."""
    return np.bincount(sizes, minlength=capacity + 1)


def handed_on(windows: list[tuple[int, int, int]], gap: int, capacity: int, limit: int) -> set[int]:
    """Which of (used, pieces, window) take part in the next exchange: those with room, the loosest first, up to ``limit`` pieces together where the count has a gap to its
    bound, and a quarter of that otherwise. The loosest always does."""
    room, out = (limit if gap else limit // CERTIFIED), set()
    for used, n, window in sorted(windows):
        room -= n
        if used == capacity or (out and room < 0):
            break
        out.add(window)
    return out


PIECES = "piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, sequence_id bigint, offset bigint, part int, gap int, open boolean"


def _pack(path: str, capacity: int, end_id: int, block_ids: int, limit: int):
    """Tokens, pieces and windows of a partition, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        kind, end = encode.dtype, np.array([end_id], encode.dtype)
        part = TaskContext.get().partitionId()
        made, held, block = part << 33, 0, []

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            sizes = [len(ids) for _, _, ids in block]
            bins = best_fit_decreasing(sizes, capacity)
            gap = len(bins) - lower_bound(histogram(np.array(sizes), capacity), capacity, len(bins))
            loose = handed_on([(sum(sizes[i] for i in b), len(b), w) for w, b in enumerate(bins)], gap, capacity, limit)
            rows: list[tuple] = []
            for w, b in enumerate(bins):
                offset = 0
                for i in b:
                    doc, piece, ids = block[i]
                    rows.append((doc, piece, piece * capacity, len(ids), ids.tobytes(), zlib.crc32(ids.astype("<u4").tobytes()), made + w, offset, part, gap, w in loose))
                    offset += len(ids)
                if len(rows) >= 4096:
                    yield batch_of(rows, id_type)
                    rows = []
            if rows:
                yield batch_of(rows, id_type)
            made += len(bins)
            block.clear()
            held = 0

        def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["_id", *(c.split()[0] for c in PIECES.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.column("_id").type
            for doc, value in zip(batch.column("_id"), batch.column("_text"), strict=True):
                ids, doc = np.append(encode(value.as_py()), end).astype(kind), doc.as_py()
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    block.append((doc, piece, ids[start : start + capacity]))
                held += len(ids)
                if held >= block_ids:
                    yield from flush(id_type)
        if block:
            yield from flush(id_type)

    return run


MOVES = "sequence_id bigint, offset bigint, length bigint, part int, window bigint, place bigint, saved bigint, open boolean"


def _repack(capacity: int, limit: int):
    """The pieces that some partitions handed on, packed anew where a bound leaves hope and the result is smaller."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["window", "place"], ignore_index=True)
        sizes, old = frame["length"].to_numpy(), frame["window"].unique()
        gap = len(old) - lower_bound(histogram(sizes, capacity), capacity, len(old))
        saved = 0
        if gap:
            bins = best_fit_decreasing(sizes.tolist(), capacity)
            if len(bins) < len(old):
                saved = len(old) - len(bins)
                window, place = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
                for w, b in zip(old, bins, strict=False):
                    window[b] = w
                    place[b] = np.cumsum(sizes[b]) - sizes[b]
                frame = frame.assign(window=window, place=place)
                gap -= saved
        used = frame.groupby("window")["length"].agg(["sum", "count"])
        loose = handed_on(list(zip(used["sum"].tolist(), used["count"].tolist(), used.index.tolist(), strict=True)), gap, capacity, limit)
        frame["saved"] = 0
        frame.loc[0, "saved"] = saved
        return frame.assign(open=frame["window"].isin(loose))[[c.split()[0] for c in MOVES.split(", ")]]

    return run


def exchange(pieces: DataFrame, capacity: int, bound: int, count: int, limit: int = HANDED_ON, fan_in: int = FAN_IN) -> tuple[DataFrame, int, list[DataFrame]]:
    """(where each piece that was handed on goes, windows in all, tables to discard). ``fan_in`` groups meet in one task at a time, which holds at most as many times ``limit``
    pieces (and what one window has); groups hand on anew, until ``bound`` is reached or one group is left. What comes out never has more windows."""
    spark_types = ["sequence_id", "offset", "length", "part"]
    items = pieces.filter("open").select(*spark_types, F.col("sequence_id").alias("window"), F.col("offset").alias("place"))
    parts = (items.agg(F.max("part")).first()[0] or 0) + 1
    done, made, width = None, [], 1
    while True:
        width *= fan_in
        groups = items.withColumn("_group", F.floor(F.col("part") / width)).groupBy("_group")
        moved = materialize(groups.applyInPandas(_repack(capacity, limit), MOVES), "moves")
        made.append(moved)
        count -= moved.agg(F.sum("saved")).first()[0] or 0
        last = width >= parts or count <= bound
        closed = (moved if last else moved.filter("not open")).select("sequence_id", "offset", "window", "place")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done, count, made
        items = moved.filter("open").select(*spark_types, "window", "place")


def pack_certified(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, block_ids: int = BLOCK_IDS, limit: int = HANDED_ON, fan_in: int = FAN_IN, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All documents in few sequences of at most ``capacity`` ids: (key, piece, start, length, ids, ids_crc32, sequence_id, offset), one row per piece.

    A document's ids, of a vocabulary of words, end with ``end_id``. A document longer than a window is cut into pieces of ``capacity`` ids, the last as long as what is left. Each
    partition packs blocks of about ``block_ids`` ids by best-fit-decreasing, where it reads them, and compares the count with its lower bound. If the count of all is above the bound for
    all pieces together, blocks hand on their loosest windows, more of them where their count has a gap than where it is certified. Those are packed anew,
    ``fan_in`` partitions in one task, until the bound is reached or one group is left. ``certificate`` tells how near the result is.

    A null or empty text is the end id alone; repeated rows and null keys are packed like any other, keys may be of any type; an empty table gives no rows; other columns
    are not read. Pieces are written once in the shared folder, and only pieces handed on are joined with their new places."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, {PIECES}"
    pieces = materialize(rows.mapInArrow(releasing(_pack(tokenizer, capacity, end_id, block_ids, limit)), schema), "packed_pieces")
    plain = [F.col("_id").alias(key), "piece", "start", "length", "ids", "ids_crc32"]
    count, bound = certificate(pieces, capacity)
    if count <= bound:
        return pieces.select(*plain, "sequence_id", "offset")
    moves, _, made = exchange(pieces, capacity, bound, count, limit, fan_in)
    places = materialize(moves, "places")
    discard(*made)
    moved = pieces.filter("open").join(places, ["sequence_id", "offset"]).select(*plain, F.col("window").alias("sequence_id"), F.col("place").alias("offset"))
    return pieces.filter("not open").select(*plain, "sequence_id", "offset").unionByName(moved)


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """Windows that ``packed`` (sequence_id, offset, length) has, and the bound for its pieces; equal numbers prove that fewer are impossible. The driver gets one
    number a size; no rows give zeros."""
    found = packed.groupBy("length").agg(F.count("*").alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("first")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in found:
        counts[row["length"]] = row["n"]
    windows = sum(row["first"] for row in found)
    return windows, lower_bound(counts, capacity, windows)

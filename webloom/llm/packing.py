"""Packing token ids into fixed windows: bounded-space online packing, and best-fit-decreasing blocks."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import array_rows, releasing, whole_key
from webloom.llm.tokens import encoder
from webloom.session import ship
from webloom.storage import materialize

#: Windows that a partition keeps open, and groups of partitions whose leftovers meet in one task.
OPEN_WINDOWS, FAN_IN = 64, 16


class OpenWindows:
    """Bounded-space best fit: at most ``limit`` open windows; what fits in none goes to a new one, for which the fullest is
    emitted if all places are taken."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit, self.made = capacity, limit, 0
        self.free: list[tuple[int, int]] = []  # (room left, window), ascending: the fullest first
        self.held: dict[int, list] = {}

    def place(self, item, size: int) -> tuple[int, int, list | None]:
        """Window and offset that ``item`` gets; the (window, items) emitted for it, or None."""
        gone = None
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            room, window = self.free.pop(k)
        else:
            if len(self.free) >= self.limit:
                _, old = self.free.pop(0)
                gone = (old, self.held.pop(old))
            room, window, self.made = self.capacity, self.made, self.made + 1
            self.held[window] = []
        offset = self.capacity - room
        self.held[window].append((item, offset))
        if room > size:
            insort(self.free, (room - size, window))
        elif gone is None:
            gone = (window, self.held.pop(window))
        else:  # both the fullest and the new one are complete
            gone = (gone[0], gone[1], window, self.held.pop(window))
        return window, offset, gone

    def rest(self) -> Iterator[tuple[int, list]]:
        """The windows still open."""
        yield from self.held.items()


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, part int, open boolean"


def _pack_partition(path: str, capacity: int, limit: int, end_id: int, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(path), OpenWindows(capacity, limit)
        part = TaskContext.get().partitionId()
        base = part << 32
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("open", pa.bool_())])
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True))
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        def emit(window: int, items: list, still_open: bool) -> None:
            nonlocal held
            for (doc, start, ids, total), offset in items:
                out.append((doc, start, len(ids), ids.tobytes(), total, base + window, offset, part, still_open))
                held += ids.nbytes + 64

        for batch in batches:
            for doc, value in zip(batch.column(key), batch.column(text), strict=True):
                ids = np.append(encode(value.as_py()), np.array([end_id], encode(None).dtype))
                doc, total = doc.as_py(), len(ids)
                for start in range(0, total, capacity):
                    piece = ids[start : start + capacity]
                    *_, gone = windows.place((doc, start, piece, total), len(piece))
                    for i in range(0, len(gone or ()), 2):
                        emit(gone[i], gone[i + 1], False)
                if held > 1 << 23:
                    yield flush()
        for window, items in windows.rest():
            emit(window, items, True)
        if out:
            yield flush()

    return run


def merge_leftovers(open_rows: DataFrame, capacity: int, limit: int = OPEN_WINDOWS) -> DataFrame:
    """Where each partly filled window goes: (sequence_id, target, shift). Windows of FAN_IN partitions meet in one task and
    are packed by best fit, largest first; the emptiest ``limit`` of what comes out meet those of the next FAN_IN groups, until one
    group is left. A task therefore never holds more than FAN_IN * limit windows, however many partitions there are."""
    items = materialize(open_rows.groupBy("sequence_id", "part").agg(F.sum("length").alias("used")), "leftovers")
    parts = (items.agg(F.max("part")).first()[0] or 0) + 1

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["used", "sequence_id"], ascending=[False, True])
        windows, target, shift, first = OpenWindows(capacity, len(frame) + 1), [], [], {}
        used: dict[int, int] = {}
        for sequence, size in zip(frame["sequence_id"], frame["used"], strict=True):
            window, offset, _ = windows.place(sequence, int(size))
            target.append(first.setdefault(window, sequence))
            shift.append(offset)
            used[first[window]] = offset + int(size)
        frame = frame.assign(target=target, shift=shift, total=[used[t] for t in target])
        emptiest = sorted(used, key=lambda t: (used[t], t))[:limit]
        return frame.assign(carried=frame["target"].isin(emptiest))[["sequence_id", "part", "target", "shift", "total", "carried"]]

    found, group = None, 1
    while True:
        group *= FAN_IN
        moved = items.withColumn("_group", F.floor(F.col("part") / group)).groupBy("_group").applyInPandas(
            lambda frame: merge(frame.drop(columns="_group")), "sequence_id bigint, part int, target bigint, shift bigint, total bigint, carried boolean"
        )
        moved = materialize(moved, "merged")
        step = moved.select("sequence_id", "target", "shift")
        if found is None:
            found = step
        else:
            found = found.join(step.select(F.col("sequence_id").alias("target"), F.col("target").alias("_next"), F.col("shift").alias("_more")), "target", "left").select(
                "sequence_id", F.coalesce("_next", "target").alias("target"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift")
            )
        if group >= parts:
            return found
        items = moved.filter("carried and sequence_id = target").select("sequence_id", "part", F.col("total").alias("used"))


def pack_online(docs: DataFrame, tokenizer: str, capacity: int = 1024, limit: int = OPEN_WINDOWS, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids, with a bounded number of open windows per partition.

    A document's ids end with ``end_id``; a document longer than a window is cut at multiples of the capacity. Returns one row
    per piece: doc_id, start, length, ids (little-endian unsigned, 16 bits where the vocabulary allows), doc_tokens, sequence_id,
    offset. A null or empty text is the end id alone; repeated rows and null keys are packed like any other; an empty table gives
    no rows; other columns are not read.

    The pieces are written once in the shared folder, so tokenising happens once; windows that were full or emitted are final
    there, and only the windows left open at each partition's end take part in the merge. Ids that are no integers are refused."""
    whole_key(docs, key)
    pieces = materialize(docs.select(F.col(key), F.col(text)).mapInArrow(releasing(_pack_partition(tokenizer, capacity, limit, end_id, key, text)), PIECES), "pieces")
    plain = ["doc_id", "start", "length", "ids", "doc_tokens"]
    moved = merge_leftovers(pieces.filter("open").select("sequence_id", "part", "length"), capacity, limit)
    last = pieces.filter("open").join(moved, "sequence_id").select(*plain, F.col("target").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return pieces.filter("not open").select(*plain, "sequence_id", "offset").unionByName(last)


class CapacityTree:
    """Open bins by room left, in a segment tree over 0 to ``capacity``: the least room that still fits is found in log steps."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        i = room + self.size
        while i:
            self.filled[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room >= need."""
        i = need + self.size
        if not self.filled[i]:
            while i > 1 and not (i % 2 == 0 and self.filled[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.filled[2 * i] else 2 * i + 1
        room = i - self.size
        found = self.bins[room].pop()
        while i:
            self.filled[i] -= 1
            i >>= 1
        return room, found


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` by bin; ties keep their order."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = tree.take(sizes[i])
        room, b = got or (capacity, len(bins))
        if got is None:
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], b)
    return bins


MATRIX = "sequence_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, starts array<bigint>"


def pack_blocks(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 50256, pad_id: int = 50256, block_ids: int = 1 << 23, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed id matrices by best-fit-decreasing within blocks of about ``block_ids`` ids of one partition.

    One row per sequence: n_tokens, ids (``capacity`` little-endian unsigned ids, padded with ``pad_id``), cu_seqlens (0, then each
    segment's end), position_ids (as many unsigned 16- or 32-bit numbers as ids, 0 again at each segment and after the last), and the
    segments' doc_ids and starts, by which the documents can be put together again. A document longer than the capacity is cut
    at its multiples; each ends with ``end_id``, so a null or empty text has one id. Repeated rows are packed as often as they come, null
    keys stay null, an empty table gives no rows, other columns are not read. Nothing is shuffled: a block is packed where it was read. Ids that are no integers are refused."""
    whole_key(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        kind = encode(None).dtype
        spots = np.dtype("<u2") if capacity <= 1 << 16 else np.dtype("<u4")
        base, made, held = TaskContext.get().partitionId() << 32, 0, 0
        block: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            bins = best_fit_decreasing([len(p[2]) for p in block], capacity)
            for at in range(0, len(bins), 1024):
                rows = []
                for b in bins[at : at + 1024]:
                    parts = [block[i] for i in b]
                    ends = np.cumsum([len(p[2]) for p in parts])
                    ids, positions = np.full(capacity, pad_id, kind), np.zeros(capacity, spots)
                    ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
                    positions[: ends[-1]] = np.concatenate([np.arange(len(p[2])) for p in parts])
                    rows.append({"sequence_id": base + made, "n_tokens": int(ends[-1]), "ids": ids.tobytes(), "cu_seqlens": [0, *ends.tolist()], "position_ids": positions.tobytes(), "doc_ids": [p[0] for p in parts], "starts": [p[1] for p in parts]})
                    made += 1
                yield pa.RecordBatch.from_pylist(rows, schema)
            block.clear()
            held = 0

        schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
        for batch in batches:
            for doc, value in zip(batch.column(key), batch.column(text), strict=True):
                ids = np.append(encode(value.as_py()), np.array([end_id], kind))
                for start in range(0, len(ids), capacity):
                    block.append((doc.as_py(), start, ids[start : start + capacity]))
                held += len(ids)
                if held >= block_ids:
                    yield from flush()
        if block:
            yield from flush()

    return docs.select(F.col(key), F.col(text)).mapInArrow(releasing(run), MATRIX)


def unpack_blocks(packed: DataFrame, wide: bool = False) -> DataFrame:
    """The reverse of pack_blocks: (doc_id, start, ids) of every segment. Null keys stay null, repeated rows give repeated segments, no rows
    give none; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 if wide else 2
        for batch in batches:
            rows = [
                {"doc_id": doc, "start": start, "ids": r["ids"][a * step : b * step]}
                for r in batch.to_pylist()
                for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())]))

    return packed.mapInArrow(releasing(run), "doc_id bigint, start bigint, ids binary")


#: Some sequences as one matrix: their ids and positions one sequence after the other, and the lists of all of them with how long each is.
STORED = "sequence_ids array<bigint>, n_tokens array<int>, ids binary, position_ids binary, cu_seqlens array<int>, segments array<int>, doc_ids array<bigint>, starts array<bigint>"


def write_matrices(packed: DataFrame, path: str, sequences: int = 1024) -> None:
    """Packed sequences as binary matrices of up to ``sequences`` rows, a matrix a row of Parquet files: ids and position_ids are contiguous, so a
    reader maps them as arrays of shape (sequences, capacity). No sequences give an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, sequences):
                part = batch.slice(at, sequences)
                flat = {c: [part.column(c).flatten()] for c in ("cu_seqlens", "doc_ids", "starts")}
                segments = pc.list_value_length(part.column("doc_ids"))
                joined = {c: b"".join(v.as_py() for v in part.column(c)) for c in ("ids", "position_ids")}
                lists = {"sequence_ids": part.column("sequence_id"), "n_tokens": part.column("n_tokens"), "segments": segments, **{c: pa.concat_arrays(v) for c, v in flat.items()}}
                columns = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in lists.items()} | {c: pa.array([v], pa.binary()) for c, v in joined.items()}
                yield pa.RecordBatch.from_arrays([columns[c.split()[0]] for c in STORED.split(", ")], names=[c.split()[0] for c in STORED.split(", ")])

    packed.select("sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts").mapInArrow(releasing(run), STORED).write.parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The sequences of stored matrices, as ``pack_blocks`` gave them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
        for row in array_rows(batches):
            n, segments = len(row["sequence_ids"]), row["segments"].to_numpy()
            ends = np.concatenate([[0], np.cumsum(segments)]).astype(np.int32)
            cuts = ends + np.arange(n + 1, dtype=np.int32)  # a sequence has one more border than segments
            cells = {c: [row[c][k * len(row[c]) // n : (k + 1) * len(row[c]) // n] for k in range(n)] for c in ("ids", "position_ids")}
            columns = {"sequence_id": row["sequence_ids"], "n_tokens": row["n_tokens"], "cu_seqlens": pa.ListArray.from_arrays(pa.array(cuts), row["cu_seqlens"])}
            columns |= {c: pa.ListArray.from_arrays(pa.array(ends), row[c]) for c in ("doc_ids", "starts")} | {c: pa.array(v, pa.binary()) for c, v in cells.items()}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    return ship(spark).read.schema(STORED).parquet(path).mapInArrow(releasing(run), MATRIX)

"""Removal of long byte strings that also start in an earlier document, by blockwise suffix sorting with a difference cover.

The suffixes compared are cut at ``length`` bytes and at the end of their document. Their order is never made in one piece:

1. Sample. Positions whose residue is in a difference cover are the sample. For any two positions there is a shift below PERIOD that
   brings both into the sample, so two suffixes compare as the at most PERIOD - 1 bytes before their common sample positions, and
   then those samples' ranks. A filter by shortened hashes finds samples that occur once only; those need no sorting. The filter
   decides nothing else: what it lets through is compared byte by byte.
2. Buckets. The left samples, each with the bytes around it, are dealt into suffix buckets, ranges of the suffix order whose
   borders come from a sample of prefixes. A bucket is sorted alone in a task of its own, which gives each of its samples a rank at every
   depth from length - PERIOD + 1 to length (suffixes with one rank at a depth agree in so many bytes).
3. Ties. Suffixes that start up to PERIOD - 1 bytes before a sample are resolved by those ranks: at a distance d, two are equal
   if their samples tie at depth length - d and the d bytes before tie too. The least id of each tie is what its members are judged by, and a
   bit for each distance goes back to the block that sent the sample.
4. Each block marks the bytes covered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import array_rows, chunks, distinct, mix, powers, prefix_hash, releasing, text_slices, whole_key
from webloom.storage import materialize

#: Differences between members of COVER give every residue modulo PERIOD (a perfect difference set).
PERIOD, COVER = 21, (3, 6, 7, 12, 14)

#: Text bytes of a block, entries that a bucket is meant to hold, bytes of a border between buckets, prefixes that borders are taken from.
BLOCK_BYTES, BUCKET_ENTRIES, PREFIX, MOST_PREFIXES = 1 << 21, 1 << 20, 24, 1 << 18

#: Prefixes that a block shows of itself: one for so many bytes.
SHOWN_EVERY = 1 << 14

BLOCKS = "block bigint, doc_ids array<bigint>, starts array<bigint>, n_bytes bigint, data binary, prefixes array<binary>"
LAST = np.iinfo(np.int64).max


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor, zstandard.ZstdCompressor]:
    """A fast one, the way back, and a tighter one, one of each a worker; making them takes longer than most of their work here."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)


def _blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """Neighbouring documents of a partition as one row per block, with the text compressed and a few of its substrings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = text_slices(batch.column(text))
            ids = batch.column(key).cast(pa.int64())
            for i, j in chunks(offsets, block_bytes):
                data = raw[offsets[i] : offsets[j]].tobytes()
                shown = [data[p : p + PREFIX] for p in range(SHOWN_EVERY // 2, len(data) - PREFIX, SHOWN_EVERY)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + made], pa.int64()), _one_list(ids[i:j]), _one_list(pa.array(offsets[i : j + 1] - offsets[i])), pa.array([len(data)], pa.int64()),
                        pa.array([_codec()[0].compress(data)], pa.binary()), pa.array([shown], pa.list_(pa.binary())),
                    ],
                    names=["block", "doc_ids", "starts", "n_bytes", "data", "prefixes"],
                )
                made += 1

    return docs.select(F.col(key), F.col(text)).mapInArrow(releasing(run), BLOCKS)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte planes apart, compressed."""
    return pack_plain(np.diff(values.astype(np.uint64, copy=False), prepend=np.uint64(0)))


def pack_plain(values: np.ndarray) -> bytes:
    """Any integers, byte planes apart, compressed."""
    return _codec()[0].compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T))


def unpack_plain(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_codec()[1].decompress(data, max_output_size=width * n), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_plain(data, n, np.uint64), dtype=np.uint64)


def pack_contexts(rows: np.ndarray, length: int) -> bytes:
    """Rows of Block.contexts with the bytes before the sample forwards again, as text packs better than text that turns round."""
    left = rows[:, length + PERIOD - 2 : length - 1 : -1]
    return _codec()[2].compress(np.concatenate([left, rows[:, :length], rows[:, -3:-1]], axis=1).tobytes())


def unpack_contexts(data: bytes, n: int, length: int) -> np.ndarray:
    reach = PERIOD - 1
    flat = np.frombuffer(_codec()[1].decompress(data, max_output_size=n * (length + reach + 2)), np.uint8).reshape(n, -1)
    return np.concatenate([flat[:, reach : reach + length], flat[:, reach - 1 :: -1], flat[:, -2:], np.ones((n, 1), np.uint8)], axis=1)


def _heads(rows: np.ndarray) -> np.ndarray:
    """Where sorted rows (of bytes, or numbers) differ from the one before."""
    out = np.ones(len(rows), bool)
    if len(rows) > 1:
        out[1:] = (rows[1:] != rows[:-1]).any(axis=1) if rows.ndim > 1 else rows[1:] != rows[:-1]
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    """Order of rows of bytes; the last byte of a row must not be zero."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="quicksort")


def _common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before (the first: none)."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 17):
        b = min(len(rows), a + (1 << 17))
        other = rows[a:b] != rows[a - 1 : b - 1]
        out[a:b] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return out


class Block:
    """Documents of one row, their cover sample, and what surrounds a sample position."""

    def __init__(self, row: dict, length: int) -> None:
        self.data = np.frombuffer(_codec()[1].decompress(row["data"], max_output_size=row["n_bytes"] + 1), np.uint8)
        self.starts = row["starts"].to_numpy()
        self.ids = row["doc_ids"].fill_null(LAST).to_numpy()
        self.length = length
        self.owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.starts))

    def sample(self) -> np.ndarray:
        """Cover positions from which a string of length - PERIOD + 1 bytes ends within its document."""
        at = (np.arange(0, len(self.data) + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
        at = at[at < len(self.data)]
        return at[at + self.length - PERIOD + 1 <= self.starts[self.owner[at] + 1]]

    def hashes(self, at: np.ndarray, bits: int) -> np.ndarray:
        """Shortened hashes of those strings."""
        n = self.length - PERIOD + 1
        sums, (_, down) = prefix_hash(self.data), powers(len(self.data) + 1)
        return mix((sums[at + n] - sums[at]) * down[at]) >> np.uint64(64 - bits)

    def shared(self, elsewhere: np.ndarray, bits: int) -> np.ndarray:
        """Sample positions whose hash other blocks have (``elsewhere``, by distinct hash) or two documents of this one."""
        at = self.sample()
        codes = self.hashes(at, bits)
        order = np.argsort(codes)
        heads = _heads(codes[order])
        first = np.flatnonzero(heads)
        if not len(first):
            return at
        owner = self.owner[at][order]
        many = elsewhere | (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first))
        return np.sort(at[order[many[np.cumsum(heads) - 1]]])

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that a string of ``length`` bytes can start before (or at), by less than PERIOD; and for each a row: ``length`` bytes
        from it, the PERIOD - 1 bytes before it backwards, the least and the greatest distance of such a start, and a 1. Bytes of other
        documents are zero, and no distance reaches them."""
        reach, n = PERIOD - 1, self.length
        owner = self.owner[at]
        right, left = np.minimum(n, self.starts[owner + 1] - at), np.minimum(reach, at - self.starts[owner])
        fits = n - right <= left
        at, right, left = at[fits], right[fits], left[fits]
        out = np.empty((len(at), n + reach + 3), np.uint8)
        padded = np.zeros(len(self.data) + reach + n, np.uint8)
        padded[reach : reach + len(self.data)] = self.data
        around = np.lib.stride_tricks.sliding_window_view(padded, n + reach)[at]
        out[:, :n], out[:, n : n + reach] = around[:, reach:], around[:, reach - 1 :: -1]
        near = np.flatnonzero(right < n)
        out[near, :n] *= np.arange(n) < right[near, None]
        near = np.flatnonzero(left < reach)
        out[near, n : n + reach] *= np.arange(reach) < left[near, None]
        out[:, -3], out[:, -2], out[:, -1] = n - right, left, 1
        return at, out

    def suffixes(self, elsewhere: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shared sample positions, the index of each one's context, the distinct contexts in order, and the least id of each."""
        at, rows = self.contexts(self.shared(elsewhere, bits))
        order = _order(rows)
        rows = rows[order]
        heads = _heads(rows)
        index = np.empty(len(at), np.int64)
        index[order] = np.cumsum(heads) - 1
        least = np.minimum.reduceat(self.ids[self.owner[at]][order], np.flatnonzero(heads)) if len(at) else np.zeros(0, np.int64)
        return at, index, rows[heads], least


ENTRIES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("suffixes", pa.binary()), ("ids", pa.binary())])
ENTRY = "bucket bigint, block bigint, n bigint, suffixes binary, ids binary"


def _dealt(block: int, buckets: np.ndarray, cuts: np.ndarray, write: Callable[[int, int], tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that the block has entries of: those from one cut to the next."""
    some = np.flatnonzero(np.diff(cuts))
    for a in range(0, len(some), 64):
        rows = []
        for k in some[a : a + 64]:
            suffixes, ids = write(int(cuts[k]), int(cuts[k + 1]))
            rows.append({"bucket": int(buckets[k]), "block": block, "n": int(cuts[k + 1] - cuts[k]), "suffixes": suffixes, "ids": ids})
        yield pa.RecordBatch.from_pylist(rows, ENTRIES)


def _answer(entries: DataFrame, find: Callable[[pd.DataFrame], list[bytes]]) -> DataFrame:
    """Run ``find`` on each bucket; it answers each row of entries. One row per block, with all answers it got."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", ignore_index=True)
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "n": frame["n"], "answer": find(frame)})

    found = entries.groupBy("bucket").applyInPandas(run, "block bigint, bucket bigint, n bigint, answer binary")
    return found.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "answer")).alias("answers"))


def _gathered(answers: pa.Array, read: Callable[[bytes, int], np.ndarray], kind: type) -> np.ndarray:
    """All answers of a block, in the order of what it sent (buckets are ranges of that order)."""
    if not len(answers):
        return np.zeros(0, kind)
    bucket, n, data = (answers.field(k) for k in range(3))
    return np.concatenate([read(data[k].as_py(), n[k].as_py()) for k in np.argsort(bucket.to_numpy())])


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _masks(data: bytes, n: int) -> np.ndarray:
    return unpack_plain(data, n, np.uint32)


def _in_many(frame: pd.DataFrame) -> list[bytes]:
    """For each row of hashes a bit each: whether more than one block has it (a block sends each once)."""
    codes = np.concatenate([unpack(r, n) for r, n in zip(frame["suffixes"], frame["n"], strict=True)])
    order = np.argsort(codes)
    heads = _heads(codes[order])
    alone = heads & np.append(heads[1:], True)
    out = np.empty(len(codes), bool)
    out[order] = ~alone
    ends = np.cumsum(frame["n"].to_numpy())
    return [np.packbits(out[b - n : b]).tobytes() for n, b in zip(frame["n"], ends, strict=True)]


def resolve(rows: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Sort one bucket's sample suffixes and resolve the suffixes before them.

    ``rows`` as made by Block.contexts, ``ids`` the least id that each came with. The result has a bit d for each: whether the string that
    starts d bytes before the sample also starts in a document with a smaller id."""
    reach, n = PERIOD - 1, length
    every = np.uint32((1 << PERIOD) - 1)
    order = _order(rows)
    rows = rows[order]
    heads = _heads(rows)
    group = np.cumsum(heads) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(heads))
    rows = rows[heads]
    depth = _common(rows[:, :n])  # bytes in common with the suffix before: ranks at a depth m change where this is below m
    own = np.zeros(len(rows), np.uint32)
    tie = np.cumsum(depth < n - reach)
    many = np.flatnonzero(np.bincount(tie)[tie] > 1)
    if len(many):  # suffixes that tie, but with other bytes around them
        part, ends, low, high, small = rows[many], depth[many], rows[many, -3], rows[many, -2], least[many]
        before = np.empty((len(many), 4 + reach + 1), np.uint8)
        before[:, :4] = tie[many].astype(">u4").view(np.uint8).reshape(-1, 4)
        before[:, 4:-1], before[:, -1] = part[:, n : n + reach], 1
        by_left = _order(before)
        left_depth = _common(before[by_left, :-1]) - 4
        for d in range(PERIOD):
            right = np.cumsum(ends < n - d)
            left = np.empty(len(many), np.int64)
            left[by_left] = np.cumsum(left_depth < d)
            valid = np.flatnonzero((low <= d) & (d <= high))
            key = right[valid] * (len(many) + 1) + left[valid]
            o = np.argsort(key)
            first = _heads(key[o])
            smallest = np.minimum.reduceat(small[valid[o]], np.flatnonzero(first)) if len(o) else small[:0]
            own[many[valid[o]]] |= (small[valid[o]] > smallest[np.cumsum(first) - 1]).astype(np.uint32) << np.uint32(d)
    out = np.empty(len(ids), np.uint32)
    out[order] = np.where(ids[order] > least[group], every, own[group])
    return out


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """Cut every byte that is covered by a ``length``-byte string which also starts in a document with a smaller id.

    Returns per document row: doc_id, n_bytes, starts and ends of the removed runs, kept (the remaining bytes). Texts are whole and
    in UTF-8, matches stay within documents, strings are judged on the input, and are equal where their bytes are. A null text is empty; texts
    shorter than ``length`` lose nothing; rows of equal id never remove from each other; a null id counts as larger than all others; an
    empty table gives no rows; other columns are not read.

    A block sends each context once, however many copies it holds, so a bucket gets a common string once a block. Buckets are not split
    within one prefix of PREFIX bytes. Ids that are no integers are refused."""
    whole_key(docs, key)
    if length < 2 * PERIOD:
        raise ValueError(f"length must be at least {2 * PERIOD}")
    blocks = materialize(_blocks(docs, key, text, block_bytes), "blocks")
    size, shown = blocks.agg(F.sum("n_bytes"), F.sum(F.size("prefixes"))).first()
    size = int(size or 0)
    samples = size * len(COVER) // PERIOD + 1
    buckets = -(-samples // bucket_entries)
    digits = max(1, (buckets - 1).bit_length())
    bits = min(63, max(samples.bit_length() + 8, digits))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in array_rows(batches):
            block = Block(row, length)
            codes = distinct(block.hashes(block.sample(), bits))
            bucket = codes >> np.uint64(bits - digits)
            first = np.flatnonzero(_heads(bucket))
            yield from _dealt(row["block"], bucket[first], np.append(first, len(codes)), lambda a, b, codes=codes: (pack(codes[a:b]), b""))

    texts = blocks.drop("prefixes")
    shared = materialize(_answer(texts.mapInArrow(releasing(sampled), ENTRY), _in_many), "shared")
    with_shared = texts.join(shared, "block", "left")

    step = max(1, -(-int(shown or 0) // MOST_PREFIXES))
    prefixes = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(step)) == 0).select(F.explode("prefixes").alias("prefix"))
    ordered = np.sort(np.array([bytes(r[0])[: length - PERIOD + 1] for r in prefixes.collect()], f"S{PREFIX}"))
    borders = np.unique(ordered[np.arange(1, buckets) * len(ordered) // buckets]) if len(ordered) else ordered

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in array_rows(batches):
            _, _, rows, ids = Block(row, length).suffixes(_gathered(row["answers"], _bits, bool), bits)
            cuts = np.concatenate([[0], np.searchsorted(rows.view(f"S{rows.shape[1]}").ravel(), borders), [len(rows)]])
            yield from _dealt(row["block"], np.arange(len(cuts) - 1), cuts, lambda a, b, rows=rows, ids=ids: (pack_contexts(rows[a:b], length), pack_plain(ids[a:b])))

    def earlier(frame: pd.DataFrame) -> list[bytes]:
        n = frame["n"].to_numpy()
        ends = np.cumsum(n)
        rows, ids = np.empty((int(ends[-1]), length + PERIOD + 2), np.uint8), np.empty(int(ends[-1]), np.int64)
        for k, b in enumerate(ends):
            rows[b - n[k] : b] = unpack_contexts(frame["suffixes"][k], int(n[k]), length)
            ids[b - n[k] : b] = unpack_plain(frame["ids"][k], int(n[k]))
        found = resolve(rows, ids, length)
        return [pack_plain(found[b - m : b]) for m, b in zip(n, ends, strict=True)]

    later = materialize(_answer(with_shared.mapInArrow(releasing(suffixes), ENTRY), earlier), "earlier").withColumnRenamed("answers", "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in array_rows(batches):
            block = Block(row, length)
            at, index, _, least = block.suffixes(_gathered(row["answers"], _bits, bool), bits)
            hit = np.zeros(len(block.data) + 1, np.int32)
            if len(at):
                mask = _gathered(row["later"], _masks, np.uint32)[index]
                mask[block.ids[block.owner[at]] > least[index]] = (1 << PERIOD) - 1
                owner = block.owner[at]
                low, high = np.maximum(0, length - (block.starts[owner + 1] - at)), np.minimum(PERIOD - 1, at - block.starts[owner])
                starts = np.zeros(len(block.data), bool)
                for d in range(PERIOD):
                    starts[at[((mask >> np.uint32(d)) & 1).astype(bool) & (low <= d) & (d <= high)] - d] = True
                first = np.flatnonzero(starts)
                hit[first] += 1
                hit[first + length] -= 1
            covered = np.cumsum(hit[:-1]) > 0
            runs, kept = [], []
            for a, b in zip(block.starts, block.starts[1:], strict=False):
                own = np.concatenate([[False], covered[a:b], [False]])
                edges = np.flatnonzero(own[1:] != own[:-1])
                runs.append((edges[::2], edges[1::2]))
                kept.append(block.data[a:b][~covered[a:b]].tobytes())
            lists = [pa.array([r[k] for r in runs], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([row["doc_ids"], pa.array(np.diff(block.starts)), *lists, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "starts", "ends", "kept"])

    return with_shared.join(later, "block", "left").mapInArrow(releasing(cut), "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")


def digest(cut: DataFrame) -> DataFrame:
    """Sizes and a digest instead of the bytes."""
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int = 50) -> list[tuple[int, int, int, int, str]]:
    """The same rows as ``digest`` from a table of all strings; for tests."""
    import hashlib

    first: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, t in raw:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out

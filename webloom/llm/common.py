"""Shared pieces of the training-data operators: tables, Arrow text access, words and shingles."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from webloom.session import ship

#: Bytes of text that the vectorised hashers handle at a time; one longer text is handled alone.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_key(docs: DataFrame, key: str) -> None:
    """Refuse ids that are no integers, before any work is done: these operators order, compare and store ids as 64-bit numbers."""
    kind = docs.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} is of type {kind}; this operator takes integer ids, so number or hash other ids first")


def release() -> None:
    """Give memory that is free inside this process back to the system. Workers outlive their tasks, and what one operator's task has
    freed but kept would count beside the next operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries can
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases free memory at its end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return inner


def text_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and len + 1 offsets into them; a null is an empty slice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count and (np.diff(off)[np.asarray(column.is_null())] != 0).any():
        return text_slices(column.fill_null(""))
    return raw, off


def array_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with lists as Arrow arrays, not as objects."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: c.slice(k, 1).flatten() if pa.types.is_list(c.type) else c[k].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True)}


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts with at most ``limit`` bytes together (a longer text alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def joined(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts i to j - 1 with one space after each, and where each starts (with the end as last entry)."""
    view = memoryview(raw)
    data = b" ".join([view[offsets[k] : offsets[k + 1]] for k in range(i, j)]) + b" "
    starts = offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1)
    return np.frombuffer(data, np.uint8), starts


def _constants() -> tuple[np.ndarray, np.uint64, np.uint64]:
    odd = 0x9E3779B97F4A7C15 | 1
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64), np.uint64(odd), np.uint64(pow(odd, -1, 1 << 64))


BYTE_CODE, BASE, BASE_INVERSE = _constants()
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64 to the powers 0 to n - 1; kept up to a few MB, else built for the call."""
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 4096)
        both = []
        for b in (BASE, BASE_INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if size > 4 * CHUNK_BYTES:
            return both[0][:n], both[1][:n]
        _powers.update(n=size, up=both[0], down=both[1])
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums over bytes: the hash of data[a:b] is (out[b] - out[a]) * BASE**-a modulo 2**64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting; numpy's own way by hashing takes several times as long on 64-bit hashes."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def word_ids(data: np.ndarray, member: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Maximal runs of bytes whose ``member`` is true: starts, for each a number that is equal exactly where the bytes mapped by ``fold``
    are, and the distinct words by number."""
    inside = member[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(fold[data[inside]])]).dictionary_encode()
    return starts, found.indices.to_numpy().astype(np.int64), found.dictionary


def word_codes(words: pa.Array) -> np.ndarray:
    """128 bits of a cryptographic digest for each word, as two columns."""
    raw, offsets = text_slices(words)
    data, bounds, make = raw.tobytes(), offsets.tolist(), hashlib.blake2b
    return np.frombuffer(b"".join([make(data[a:b], digest_size=16).digest() for a, b in zip(bounds, bounds[1:], strict=False)]), np.uint64).reshape(-1, 2)


def lower_fold() -> np.ndarray:
    """Byte map that lower-cases A-Z alone."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


FOLD = lower_fold()


def not_blank() -> np.ndarray:
    """Bytes of words in ``[^\\x20\\x09-\\x0D]+``."""
    out = np.ones(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = False
    return out


def alphanumeric() -> np.ndarray:
    """Bytes of words in ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    out = np.zeros(256, bool)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    return out


NOT_BLANK, ALPHANUMERIC = not_blank(), alphanumeric()


def dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's rank among the distinct ones, and where one of each rank is."""
    order = np.argsort(values)
    heads = np.ones(len(values), bool)
    np.not_equal(values[order[1:]], values[order[:-1]], out=heads[1:])
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(heads) - 1
    return out, order[heads]


class Shingles:
    """All runs of ``width`` words of one text, for texts with the given words; a text with fewer words, but not none, has its whole
    sequence as one. Runs are numbered without hashing: equal numbers are equal words."""

    def __init__(self, ids: np.ndarray, size: int, bounds: np.ndarray, width: int) -> None:
        counts = np.diff(bounds)
        n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
        self.width, self.ids, self.texts, self.size = width, ids, len(counts), size
        self.owner = np.repeat(np.arange(len(counts)), n)
        self.start = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.end = np.repeat(bounds[1:], n)
        code, room = ids[self.start], size
        for k in range(1, width):
            if room > (1 << 62) // (size + 1):
                code, first = dense(code)
                room = len(first)
            code = code * (size + 1) + self.word(k, slice(None))
            room *= size + 1
        self.number, self.first = dense(code)

    def word(self, k: int, rows) -> np.ndarray:
        """The k-th word of runs (``size`` where a short text has ended)."""
        at = self.start[rows] + k
        inside = at < self.end[rows]
        return np.where(inside, self.ids[np.where(inside, at, 0)], self.size) if len(self.ids) else at

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """A hash of each distinct run, by number, from its words' codes."""
        codes = np.append(codes, np.uint64(0))
        out = np.zeros(len(self.first), np.uint64)
        for k in range(self.width):
            out = mix(out + codes[self.word(k, self.first)] * np.uint64(2 * k + 3))
        return out

    def sets(self, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct numbers of each text, ascending, and where each text's begin (with the end)."""
        number = self.number if number is None else number
        n = max(1, len(self.first))
        pairs = distinct(self.owner * n + number)
        return pairs % n, np.searchsorted(pairs, np.arange(self.texts + 1) * n)


def text_shingles(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, width: int, member: np.ndarray, fold: np.ndarray) -> tuple[Shingles, pa.Array]:
    """Shingles of texts i to j - 1, and their distinct words."""
    data, text_starts = joined(raw, offsets, i, j)
    starts, ids, vocabulary = word_ids(data, member, fold)
    return Shingles(ids, len(vocabulary), np.searchsorted(starts, text_starts), width), vocabulary

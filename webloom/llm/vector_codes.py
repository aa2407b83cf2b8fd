"""Compression of vectors into codebook indices, with exact nearest entries found by annular norm pruning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from webloom.llm.common import releasing, text_slices
from webloom.session import ship
from webloom.storage import discard, materialize

#: Components of integer vectors are held within this, so that all squared distances fit 64 bits (at 2**11 components and less).
LARGEST = 1 << 25

#: Labels that are sent to all tasks with their sums (at most some MB); with more, the sums are joined by salted keys.
BROADCAST_LABELS, SALTS = 1 << 16, 16


def norm_order(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of codebook entries by norm (ties by index), and those norms."""
    norms = np.sqrt((book * book).sum(axis=1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    return order, norms[order]


def annulus(norms: np.ndarray, own: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For points of norm ``own`` with the squared distance ``best`` so far: the run of sorted ``norms`` that may be as near. By the triangle inequality
    an entry's distance is at least the difference of norms; the slack is far above what rounding moves, so no tie is lost."""
    reach = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (own + reach) + 1e-9
    return np.searchsorted(norms, own - reach - slack, "left"), np.searchsorted(norms, own + reach + slack, "right")


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each row of ``points`` (64-bit integers), the lower one of equals, and the squared distance.

    A point starts at the entry of nearest norm and looks outwards in the sorted norms, on both sides in turn; each better distance narrows the annulus, and
    entries outside it are not evaluated. Entries on its border are, so ties are seen."""
    order, norms = norm_order(book)
    own = np.sqrt((points * points).sum(axis=1).astype(np.float64))
    right = np.minimum(np.searchsorted(norms, own), len(book) - 1)
    left = np.maximum(right - 1, 0)
    start = np.where(own - norms[left] < norms[right] - own, left, right)
    index = order[start]
    best = ((points - book[index]) ** 2).sum(axis=1)
    low, high = annulus(norms, own, best)
    for step in range(1, len(book)):
        for at in (start - step, start + step):
            rows = np.flatnonzero((at >= low) & (at < high))
            if not len(rows):
                continue
            entry = order[at[rows]]
            distance = ((points[rows] - book[entry]) ** 2).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
            rows, entry, distance = rows[better], entry[better], distance[better]
            index[rows], best[rows] = entry, distance
            low[rows], high[rows] = annulus(norms, own[rows], distance)
    return index, best


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column as doubles (null: not a number), and where each row's begin."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64())
    return values.fill_null(np.nan).to_numpy(zero_copy_only=False), offsets - offsets[0]


def integer_vectors(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, size, vec) of all rows whose vector is whole and finite: floor(scale * x) as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_vec")
            values, offsets = _flat(column)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~np.asarray(column.is_null())
            whole = np.clip(np.floor(np.nan_to_num(values, posinf=0, neginf=0) * scale), -LARGEST, LARGEST).astype("<i4")
            rows = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(np.diff(offsets).astype(np.int32)), rows], names=["_id", "_label", "_size", "_vec"])
            yield out.filter(pa.array(keep))

    rows = vectors.select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_vec"))
    return rows.mapInArrow(releasing(run), f"_id {rows.schema['_id'].dataType.simpleString()}, _label {rows.schema['_label'].dataType.simpleString()}, _size int, _vec binary")


def _points(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The vectors of a batch, all of ``size`` components."""
    raw, offsets = text_slices(batch.column("_vec"))
    return raw[offsets[0] : offsets[-1]].view("<i4").reshape(-1, size).astype(np.int64)


def update(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of shape (parts, entries, width) after one round: each entry is the floor of the mean of the parts nearest to it, an unused one stays.
    Tasks send one number a component; the driver gets as many as the codebooks have."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            points = _points(batch, parts * width)
            for p in range(parts):
                part = points[:, p * width : (p + 1) * width]
                index, _ = nearest(part, books[p])
                np.add.at(totals[p], index, np.concatenate([part, np.ones((len(part), 1), np.int64)], axis=1))
        used = np.flatnonzero(np.repeat(totals[:, :, -1] > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals.reshape(-1)[used])], names=["cell", "total"])

    found = stored.select("_vec").mapInArrow(releasing(run), "cell int, total bigint").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    totals = np.zeros(parts * entries * (width + 1), np.int64)
    for cell, total in found:
        totals[cell] = total
    totals = totals.reshape(parts, entries, width + 1)
    count = totals[:, :, -1:]
    return np.where(count > 0, totals[:, :, :-1] // np.maximum(count, 1), books)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def train(stored: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of stored integer vectors of one size: the vectors of the least ids, after ``rounds`` rounds; fewer vectors than
    ``entries`` give as many entries, none give None. Of one id's several vectors the least by bytes comes first; null ids come last."""
    first = stored.orderBy(F.col("_id").asc_nulls_last(), "_vec").select("_vec").limit(entries).collect()
    if not first:
        return None
    start = np.array([np.frombuffer(row[0], "<i4") for row in first]).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = update(stored, books)
    return books


def encode(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """(_id, _label, code, error) of stored vectors: two hex digits for each part's nearest entry, and the squared distances summed."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch, parts * width)
            codes, error = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
            for p in range(parts):
                index, distance = nearest(points[:, p * width : (p + 1) * width], books[p])
                codes[:, p] = index
                error += distance
            text, step = codes.tobytes().hex(), 2 * parts
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], names=["_id", "_label", "code", "error"]
            )

    schema = StructType([stored.schema["_id"], stored.schema["_label"], StructField("code", StringType()), StructField("error", LongType())])
    return stored.select("_id", "_label", "_vec").mapInArrow(releasing(run), schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The errors of all rows of a label, beside each of its rows. The sums are sent to all tasks where there are at most BROADCAST_LABELS labels; with more,
    rows and sums meet by (label, salt), so that a label with a third of all rows is no single task's."""
    sums = materialize(coded.groupBy(F.col("_label").alias("_of")).agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error")), "label_errors")
    same = F.col("_label").eqNullSafe(F.col("_of"))
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("_of")
    salted = sums.withColumn("_salt_of", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64("_id", "code", "error"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("_salt") == F.col("_salt_of"))).drop("_of", "_salt", "_salt_of")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Vectors as codebook indices: (key, code, error, label_error, codebooks_sha256), as the contract of the codes says (codebooks from the least ids,
    ``rounds`` rounds of assignment and floored means, a last assignment).

    Rows whose vector is null or has null or non-finite components are dropped. The size of vectors is that of the least id whose size is a positive
    multiple of ``parts``; a vector of another size stays, with null code and error. Components of over 2**25 / ``scale`` in size count as that, so that distances fit
    64 bits. Repeated rows count as often as they come, equal distances take the lower entry, null labels are one label, null ids are the greatest; an empty
    table gives no rows; other columns are not read. Integer vectors are written once in the shared folder; a round reads them and returns sums."""
    ship(vectors.sparkSession)
    stored = materialize(integer_vectors(vectors, key, vector, label, scale), "integer_vectors")
    fits = (F.col("_size") > 0) & (F.col("_size") % parts == 0)
    first = stored.filter(fits).orderBy(F.col("_id").asc_nulls_last(), "_vec").select("_size").limit(1).collect()
    size = first[0][0] if first else 0
    other = stored.filter(F.col("_size") != size).select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    books = train(stored.filter(F.col("_size") == size), parts, entries, rounds) if size else None
    coded, digest = other, hashlib.sha256(b"").hexdigest()
    if books is not None:
        digest = books_digest(books)
        coded = encode(stored.filter(F.col("_size") == size), books).unionByName(other)
    coded = materialize(coded, "codes")
    discard(stored)
    return with_label_errors(coded).select(F.col("_id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

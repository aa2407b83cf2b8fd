"""Quality scores by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import FOLD, NOT_BLANK, alphanumeric, chunks, joined, mix, powers, prefix_hash, releasing, text_slices

#: Labelled rows that a model learns from at most, distinct n-grams that they may have together, hash bits, passes over the rows, and the
#: factor that keeps n-gram shares near 1.
MOST_ROWS, MOST_NGRAMS, BITS, EPOCHS, SCALE = 12_000, 48_000_000, 18, 4, 16.0

#: Bytes of text that are turned into n-grams at a time; each byte takes about a hundred bytes of arrays.
TEXT_AT_ONCE = 1 << 19

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def ngrams(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of texts i to j - 1, text by text, and where each text's begin (with the end).

    Words are runs of letters and digits or runs of other visible characters. A word gives its folded form; its shape (how it is written
    and its length, or the characters themselves if it has no letters) gives a second sequence, since most long words of an unseen text
    are new. Unigrams and bigrams of forms, and n-grams of one to three shapes, share one hash space with marks for words that repeat one of
    the four before them."""
    data, text_starts = joined(raw, offsets, i, j)
    letters = alphanumeric()[data]
    kind = np.where(letters, 1, np.where(NOT_BLANK[data], 2, 0)).astype(np.int8)
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[:-1], edge[1:]
    keep = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    sums = prefix_hash(FOLD[data])
    _, down = powers(len(data) + 1)
    form = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    upper = _UPPER[data]
    upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    n_upper, n_digit = (np.concatenate([[0], np.cumsum(x)]) for x in (upper, _DIGIT[data]))
    length = ends - starts
    caps, digits = n_upper[ends] - n_upper[starts], n_digit[ends] - n_digit[starts]
    style = np.where(digits > 0, 4, np.where(caps == 0, 0, np.where((caps == 1) & upper[starts] & (length > 1), 1, np.where(2 * caps >= length, 2, 3))))
    shape = np.where(letters[starts], mix((style * 64 + np.minimum(length, 20)).astype(np.uint64)), form) if len(starts) else form
    bounds = np.searchsorted(starts, text_starts)
    owner = np.repeat(np.arange(j - i), np.diff(bounds))
    parts, owners = [form * np.uint64(3), mix(shape + np.uint64(11))], [owner, owner]
    for seq, width, salt in ((form, 2, 5), (shape, 2, 17), (shape, 3, 23)):
        if len(seq) >= width:
            acc = np.full(len(seq) - width + 1, salt, np.uint64)
            for k in range(width):
                acc = mix(acc + seq[k : len(seq) - width + 1 + k] * np.uint64(2 * k + 1))
            whole = owner[: len(acc)] == owner[width - 1 :]
            parts.append(acc[whole])
            owners.append(owner[: len(acc)][whole])
    for back in range(1, 5):  # a word that repeats one shortly before it, whatever the word
        if len(form) > back:
            again = np.flatnonzero((form[back:] == form[:-back]) & (owner[back:] == owner[:-back])) + back
            parts.append(mix(np.full(len(again), 101 + back, np.uint64)))
            owners.append(owner[again])
    all_, own = np.concatenate(parts) >> np.uint64(64 - bits), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return all_[order].astype(np.int32), np.searchsorted(own[order], np.arange(j - i + 1))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    """Weights of 2**bits hashed n-grams and a bias."""

    bits: int
    weights: np.ndarray
    bias: float

    def margins(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sparse dot products: each text's n-gram shares times their weights."""
        n, out = np.diff(bounds), np.zeros(len(bounds) - 1)
        some = np.flatnonzero(n)
        if len(some):  # each text is summed by itself, so that equal texts get equal scores
            out[some] = np.add.reduceat(self.weights[codes].astype(np.float64), bounds[some])
        return self.bias + SCALE * out / np.maximum(n, 1)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> Model:
    """FTRL-proximal over (label, n-gram codes, counts), in a fixed shuffled order for each pass. The last cell is the bias."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            label, codes, counts = rows[k]
            at = np.append(codes, size - 1)
            x = np.append(SCALE * counts / max(counts.sum(), 1), 1.0)
            g = (sigmoid(w[at] @ x) - label) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w[at]
            n[at] = grown
            zi = z[at]
            w[at] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(grown)) / alpha + l2))
    return Model(bits, w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, bits: int = BITS, key: str = "doc_id", text: str = "text", most_ngrams: int = MOST_NGRAMS) -> Model:
    """Learn from at most ``most_rows`` labelled ids (those with the least hash), as far as their documents have at most ``most_ngrams`` distinct
    n-grams together. One task gets their counts in that order and trains; the driver gets the weights alone. An id with several labels
    counts by the least one; several documents of one id count each; rows with a null label or id are not used; without any rows all scores
    are 0.5."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_label"))
    chosen = chosen.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(most_rows)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_slices(batch.column("_text"))
            for i, j in chunks(offsets, TEXT_AT_ONCE):
                codes, bounds = ngrams(raw, offsets, i, j, bits)
                found = [np.unique(codes[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:], strict=False)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_order"), part.column("_label"), pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())],
                    names=["order", "label", "codes", "counts"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, left = [], most_ngrams
        for batch in batches:
            for label, codes, counts in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                left -= len(codes.as_buffer()) // 4
                if left >= 0:
                    got.append((label.as_py(), np.frombuffer(codes.as_py(), np.int32), np.frombuffer(counts.as_py(), "<u4")))
        model = train(got, bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"])

    counted = rows.select("_order", "_text", "_label").mapInArrow(releasing(count), "order bigint, label int, codes binary, counts binary")
    ordered = counted.repartition(1).sortWithinPartitions("order", "codes", "counts")
    weights, bias = ordered.mapInArrow(releasing(learn), "weights binary, bias double").first() or (np.zeros(1 << bits, np.float32).tobytes(), 0.0)
    return Model(bits, np.frombuffer(weights, np.float32), bias)


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of every row, and its score from 0 to 1. A null or empty text has no n-grams; its score is the bias's."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{name} double"])
    inner = docs.select(*columns, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_slices(batch.column("_text"))
            for i, j in chunks(offsets, TEXT_AT_ONCE):
                found = sigmoid(sent.value.margins(*ngrams(raw, offsets, i, j, sent.value.bits)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(found)], names=[*columns, name])

    return inner.mapInArrow(releasing(run), schema)


def held_out(key: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = MOST_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every document row, by a model that never saw held-out labels.

    Null and empty texts get the bias's score; equal texts equal scores; repeated rows are scored each; a null id is not held out and
    never learned from; empty tables are allowed; other columns are not read."""
    model = fit(docs, labels.filter(~held_out(key)), "quality", most_rows, key=key, text=text)
    return score(docs, model, [key], text).select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

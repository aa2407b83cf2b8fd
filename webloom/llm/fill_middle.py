"""Fill-in-the-middle transformation: cut ranks are found by counting unit borders in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import releasing, text_slices
from webloom.session import ship
from webloom.storage import discard, materialize

#: Bytes of a chunk; a text of one chunk owns both its cuts and goes no further than the task that read it.
CHUNK_BYTES = 1 << 16

#: Signs of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _tail(data: np.ndarray) -> np.ndarray:
    """Bytes inside a UTF-8 character."""
    return (data & 0xC0) == 0x80


#: Whether a unit ends between two adjacent bytes, by unit. All borders are between characters, as they look at ASCII bytes or at a character's first byte.
BORDERS = {
    "line": lambda a, b: a == 10,
    "word": lambda a, b: ((a == 32) | (a - 9 < 5)) & (b != 32) & (b - 9 >= 5),  # unsigned: below 9 wraps round
    "char": lambda a, b: ~_tail(b),
}


def borders(chunk: np.ndarray, size: int, unit: str) -> np.ndarray:
    """Where units end in the first ``size`` bytes of a chunk, which overlaps the next one: positions just after a unit. A text's last byte ends its
    last unit, so where nothing follows the end counts too."""
    found = np.flatnonzero(BORDERS[unit](chunk[:-1], chunk[1:])[:size]) + 1
    return np.append(found, size) if len(chunk) == size and size else found


def count_chars(data: np.ndarray) -> int:
    """Characters that start in these bytes."""
    return len(data) - int(np.count_nonzero(_tail(data)))


def chunk_bounds(n: int, size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, own end, end with the overlap) of the chunks of ``n`` bytes; an empty text is one empty chunk."""
    for start in range(0, max(n, 1), size):
        yield start, min(n, start + size), min(n, start + size + overlap)


def cut_ranks(n: int, first: int, second: int) -> tuple[int, int]:
    """Units before the first and the second cut of a text of ``n`` units."""
    a, b = first % (n + 1), second % (n + 1)
    return min(a, b), max(a, b)


def rank_offset(marks: np.ndarray, rank: int) -> int:
    """Bytes of a chunk up to the end of its ``rank``-th unit end."""
    return int(marks[rank - 1]) if rank else 0


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes, signs: list[bytes]) -> bytes:
    """The output of a form."""
    p, s, m = signs
    if form == "psm":
        return b"".join([p, prefix, s, suffix, m, middle])
    if form == "spm":
        return b"".join([s, suffix, p, prefix, m, middle])
    return b"".join([prefix, middle, suffix])


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made from: a text with a sign in it is never transformed, so the signs part an output uniquely."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and key; a null key draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"_h{k + 1}") for k in range(4)]


def form_of(empty: Column | bool, marked: Column | bool, rate: int, spm: int) -> Column:
    """Plain, psm or spm, by the third and fourth draw."""
    return F.when(empty | marked | (F.col("_h3") % 100 >= rate), "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm")


RESULT = "n bigint, prefix_chars bigint, middle_chars bigint, output binary"


def _single(unit: str, sentinels: tuple[str, ...], rate: int, spm: int):
    """Texts of one chunk: the same counting and ranks, in the task that has the text."""
    signs = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_slices(batch.column("_text"))
            h1, h2, h3, h4 = (batch.column(f"_h{k}").to_pylist() for k in range(1, 5))
            n, forms, before, between, out = [], [], [], [], []
            for k in range(batch.num_rows):
                chunk = raw[offsets[k] : offsets[k + 1]]
                marks, data = borders(chunk, len(chunk), unit), chunk.tobytes()
                plain = not data or any(s in data for s in signs) or h3[k] % 100 >= rate
                forms.append("plain" if plain else "spm" if h4[k] % 100 < spm else "psm")
                a, b = (rank_offset(marks, rank) for rank in cut_ranks(len(marks), h1[k], h2[k]))
                n.append(len(marks))
                before.append(None if plain else count_chars(chunk[:a]))
                between.append(None if plain else count_chars(chunk[a:b]))
                out.append(arranged(forms[-1], data[:a], data[a:b], data[b:], signs))
            columns = [batch.column("_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _split(size: int, overlap: int):
    """Long texts as rows of overlapping chunks, under a number that is the text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            raw, offsets = text_slices(batch.column("_text"))
            for k in range(batch.num_rows):
                text = raw[offsets[k] : offsets[k + 1]]
                bounds = list(chunk_bounds(len(text), size, overlap))
                m = len(bounds)
                for i in range(0, m, 64):  # some MB at a time
                    part = bounds[i : i + 64]
                    draw = [pa.array([batch.column(c)[k].as_py()] * len(part), batch.column(c).type) for c in ("_id", "_h1", "_h2", "_h3", "_h4")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([base + made] * len(part), pa.int64()), *draw, pa.array(range(i, i + len(part)), pa.int32()), pa.array([e - s for s, e, _ in part], pa.int32()), pa.array([text[s:o].tobytes() for s, _, o in part], pa.binary())],
                        names=["_text_no", "_id", "_h1", "_h2", "_h3", "_h4", "_chunk", "_own", "_bytes"],
                    )
                made += 1

    return run


def _count(unit: str, sentinels: tuple[str, ...]):
    """Unit ends of each chunk, and whether a sign starts there."""
    signs = [s.encode() for s in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_slices(batch.column("_bytes"))
            chunks = [raw[offsets[k] : offsets[k + 1]] for k in range(batch.num_rows)]
            counts = [len(borders(c, own, unit)) for c, own in zip(chunks, batch.column("_own").to_pylist(), strict=True)]
            marked = [any(s in c.tobytes() for s in signs) for c in chunks]
            yield pa.RecordBatch.from_arrays([batch.column("_text_no"), batch.column("_chunk"), pa.array(counts, pa.int64()), pa.array(marked)], names=["_text_no", "_chunk", "_ends", "_marked"])

    return run


def _locate(unit: str):
    """In a chunk that owns a cut: where the unit with the wanted rank ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_slices(batch.column("_bytes"))
            at = [
                rank_offset(borders(raw[offsets[k] : offsets[k + 1]], own, unit), rank)
                for k, (own, rank) in enumerate(zip(batch.column("_own").to_pylist(), batch.column("_rank").to_pylist(), strict=True))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_text_no"), batch.column("_cut"), batch.column("_chunk"), pa.array(at, pa.int64())], names=["_text_no", "_cut", "_chunk", "_at"])

    return run


def _assemble(size: int, sentinels: tuple[str, ...]):
    """Chunks of a text, in order, put together by its form; one text at a time is held."""
    signs = [s.encode() for s in sentinels]

    def finish(row: dict, chunks: list[bytes]) -> pa.RecordBatch:
        text, form = b"".join(chunks), row["form"]
        a, b = ((row[c] * size + row[at]) for c, at in (("_chunk1", "_at1"), ("_chunk2", "_at2")))
        view = np.frombuffer(text, np.uint8)
        chars = (None, None) if form == "plain" else (count_chars(view[:a]), count_chars(view[a:b]))
        values = [row["_text_no"], row["n"], *chars, arranged(form, text[:a], text[a:b], text[b:], signs)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["_text_no", "n", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, chunks = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("_text_no")[k].as_py()
                if row is None or row["_text_no"] != number:
                    if row is not None:
                        yield finish(row, chunks)
                    row = {c: batch.column(c)[k].as_py() for c in ("_text_no", "n", "form", "_chunk1", "_at1", "_chunk2", "_at2")}
                    chunks = []
                own = batch.column("_own")[k].as_py()
                chunks.append(batch.column("_bytes")[k].as_py()[:own])
        if row is not None:
            yield finish(row, chunks)

    return run


def _long(texts: DataFrame, unit: str, rate: int, spm: int, sentinels: tuple[str, ...], size: int) -> DataFrame | None:
    """Texts of several chunks, or None where there are none. Chunks are counted in parallel, running sums of their counts tell which chunk owns a cut, and only those are scanned again."""
    spark = texts.sparkSession
    id_type = texts.schema["_id"].dataType.simpleString()
    overlap = max(1, max(len(s.encode()) for s in sentinels) - 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = f"_text_no bigint, _id {id_type}, _h1 bigint, _h2 bigint, _h3 bigint, _h4 bigint, _chunk int, _own int, _bytes binary"
    chunks = materialize(texts.mapInArrow(releasing(_split(size, overlap)), columns).repartition(parts, "_text_no", "_chunk"), "text_chunks")
    if chunks.isEmpty():
        discard(chunks)
        return None
    counts = materialize(chunks.select("_text_no", "_chunk", "_own", "_bytes").mapInArrow(releasing(_count(unit, sentinels)), "_text_no bigint, _chunk int, _ends bigint, _marked boolean"), "chunk_counts")

    whole = counts.groupBy("_text_no").agg(F.sum("_ends").alias("n"), F.max("_marked").alias("_marked"))
    drawn = chunks.filter("_chunk = 0").select("_text_no", "_id", "_h1", "_h2", "_h3", "_h4").join(whole, "_text_no")
    ranks = [F.col(h) % (F.col("n") + 1) for h in ("_h1", "_h2")]
    drawn = drawn.select("_text_no", "_id", "n", form_of(F.lit(False), F.col("_marked"), rate, spm).alias("form"), F.least(*ranks).alias("_r1"), F.greatest(*ranks).alias("_r2"))
    drawn = materialize(drawn, "text_cuts")

    upto = F.sum("_ends").over(Window.partitionBy("_text_no").orderBy("_chunk"))
    placed = counts.withColumn("_before", upto - F.col("_ends"))
    wanted = drawn.select("_text_no", F.posexplode(F.array("_r1", "_r2")).alias("_cut", "_whole_rank"))
    # rank 0 is the first chunk's start; any other rank belongs to the chunk in whose run of counts it lies
    owns = ((F.col("_whole_rank") > F.col("_before")) & (F.col("_whole_rank") <= F.col("_before") + F.col("_ends"))) | ((F.col("_whole_rank") == 0) & (F.col("_chunk") == 0))
    owners = wanted.join(placed, "_text_no").filter(owns).select("_text_no", "_chunk", "_cut", (F.col("_whole_rank") - F.col("_before")).alias("_rank"))
    scanned = chunks.select("_text_no", "_chunk", "_own", "_bytes").join(owners, ["_text_no", "_chunk"]).mapInArrow(releasing(_locate(unit)), "_text_no bigint, _cut int, _chunk int, _at bigint")
    cuts = scanned.groupBy("_text_no").agg(*(F.max(F.when(F.col("_cut") == c, F.col(v))).alias(f"{v}{c + 1}") for c in (0, 1) for v in ("_chunk", "_at")))
    cuts = materialize(drawn.join(cuts, "_text_no").drop("_r1", "_r2"), "text_offsets")

    sorted_chunks = chunks.select("_text_no", "_chunk", "_own", "_bytes").join(cuts.drop("_id"), "_text_no").repartition(parts, "_text_no").sortWithinPartitions("_text_no", "_chunk")
    made = materialize(sorted_chunks.mapInArrow(releasing(_assemble(size, sentinels)), f"_text_no bigint, {RESULT}"), "long_outputs")
    out = materialize(made.join(cuts.select("_text_no", "_id", "form"), "_text_no").select("_id", "n", "form", "prefix_chars", "middle_chars", "output"), "long_texts")
    discard(chunks, counts, drawn, cuts, made)
    return out


def fill_in_middle(
    docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Documents with a middle moved to the end: (key, n, form, prefix_chars, middle_chars, output).

    A text is ``n`` units (lines, each with its line feed; or words with the blanks before the next; or characters). Four numbers drawn from ``seed`` and the key give two
    cut ranks, whether the text is transformed (``rate`` percent) and whether as spm (``spm`` percent) or psm. A null or empty text, one that contains a sentinel and one that is
    not drawn stay as they are, with null characters. Equal ids draw equal numbers, so repeated rows give repeated rows; a null id draws like an empty one, ids of
    other types by their decimal or text form; an empty table gives no rows; other columns are not read.

    A text is a run of chunks of ``chunk_bytes`` that overlap by what the predicate on adjacent bytes and a sentinel's length need. A text of one chunk is counted, cut and put
    together where it was read. Chunks of longer texts go to different tasks to be counted; running sums route each cut to the chunk that owns it."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), *draws(F.col(key), seed))
    id_type = texts.schema["_id"].dataType.simpleString()
    is_long = F.octet_length("_text") > chunk_bytes
    schema = f"_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    out = texts.filter(~F.coalesce(is_long, F.lit(False))).mapInArrow(releasing(_single(unit, sentinels, rate, spm)), schema)
    rest = _long(texts.filter(is_long), unit, rate, spm, sentinels, chunk_bytes)
    if rest is not None:
        out = out.unionByName(rest)
    return out.select(F.col("_id").alias(key), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))

"""Benchmark contamination by a document-partitioned positional inverted index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import ALPHANUMERIC, FOLD, array_rows, chunks, joined, releasing, text_slices, whole_key, word_ids
from webloom.storage import discard, materialize

#: Words of a window, and bytes of benchmark texts that are matched in one pass over the index (further texts: further passes).
WINDOW, QUERY_BYTES = 13, 1 << 23

INDEX = "block bigint, n_words bigint, terms binary, counts binary, postings binary, doc_ids array<bigint>, doc_starts array<bigint>"


def _tokens(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of texts i to j - 1 by number, the distinct words, and where each text's words begin (with the end)."""
    data, text_starts = joined(raw, offsets, i, j)
    starts, ids, vocabulary = word_ids(data, ALPHANUMERIC, FOLD)
    return ids, vocabulary, np.searchsorted(starts, text_starts)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = 1 << 22) -> DataFrame:
    """Positional postings of whole texts, one row per block of neighbouring documents of a partition.

    A row holds the block's terms (its distinct words), how often each occurs, and for each term its word positions in the
    block, ascending, as zstandard-compressed differences; doc_starts says which positions are whose. Words are the contract's:
    A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Nulls and empty texts have no postings but keep their place; repeated
    rows and null keys are kept as they are; an empty table has no blocks; other columns are not read. Ids that are no integers are refused."""
    whole_key(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        made, base = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = text_slices(batch.column(text))
            ids = batch.column(key).cast(pa.int64())
            for i, j in chunks(offsets, block_bytes):
                numbers, vocabulary, doc_starts = _tokens(raw, offsets, i, j)
                order = np.argsort(numbers, kind="stable").astype(np.uint32)
                counts = np.bincount(numbers, minlength=len(vocabulary))
                firsts = np.cumsum(counts) - counts
                gaps = np.diff(order, prepend=np.uint32(0))
                gaps[firsts] = order[firsts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + made], pa.int64()),
                        pa.array([len(numbers)], pa.int64()),
                        pa.array([pack.compress(b" ".join(vocabulary.to_pylist()))], pa.binary()),
                        pa.array([pack.compress(counts.astype(np.uint32).tobytes())], pa.binary()),
                        pa.array([pack.compress(gaps.tobytes())], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids[i:j]),
                        pa.ListArray.from_arrays(pa.array([0, j - i + 1], pa.int32()), pa.array(doc_starts, pa.int64())),
                    ],
                    names=["block", "n_words", "terms", "counts", "postings", "doc_ids", "doc_starts"],
                )
                made += 1

    return docs.select(F.col(key), F.col(text)).mapInArrow(releasing(run), INDEX)


class Block:
    """One row of the index, opened."""

    def __init__(self, row: dict) -> None:
        unpack = zstandard.ZstdDecompressor()
        self.n = row["n_words"]
        self.terms = pa.array(unpack.decompressobj().decompress(row["terms"]).split(b" ") if self.n else [], pa.large_binary())
        self.counts = np.frombuffer(unpack.decompress(row["counts"], max_output_size=4 * len(self.terms) + 64), np.uint32).astype(np.int64) if len(self.terms) else np.zeros(0, np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.positions = np.zeros(0, np.int64)
        if self.n:
            gaps = np.frombuffer(unpack.decompress(row["postings"], max_output_size=4 * self.n + 64), np.uint32).astype(np.int64)
            total = np.cumsum(gaps)
            self.positions = total - np.repeat(total[self.firsts] - gaps[self.firsts], self.counts)
        #: Term and position in one ascending number: one list's entries are neighbours, and any entry is found by bisection.
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * (self.n + 1) + self.positions
        self.doc_starts = np.asarray(row["doc_starts"], np.int64)
        self.doc_ids = row["doc_ids"]

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Number of each word's term in this block, -1 where it has no postings."""
        return pc.index_in(words, value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)

    def has(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the term of each rank has a posting at each position."""
        key = rank * (self.n + 1) + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def doc(self, position: np.ndarray) -> np.ndarray:
        """Which document of the block each position is in."""
        return np.searchsorted(self.doc_starts, position, side="right") - 1

    def _rarest_first(self, phrases: np.ndarray, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For phrases whose terms all occur here: (phrase, position of its rarest term, ranks, terms from rarest to most common)."""
        whole = np.flatnonzero((phrases >= 0).all(axis=1))
        if not len(whole):
            return
        ranks = phrases[whole]
        order = np.argsort(self.counts[ranks], axis=1, kind="stable")
        rare = ranks[np.arange(len(whole)), order[:, 0]]
        sums = np.cumsum(self.counts[rare])
        i = 0
        while i < len(whole):
            j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + at_once, side="right")))
            row, at = self._lists(rare[i:j])
            yield whole[i + row], self.positions[at], ranks[i + row], order[i + row]
            i = j

    def _lists(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the lists of these terms: (which of them, entry)."""
        return _expanded(self.firsts[ranks], self.firsts[ranks] + self.counts[ranks])

    def phrases(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of phrases (rows of ranks) inside single documents: (phrase, first position)."""
        found = []
        length = phrases.shape[1]
        for phrase, position, ranks, order in self._rarest_first(phrases):
            start = position - order[:, 0]
            left = np.flatnonzero((start >= 0) & (start + length <= self.n))
            left = left[self.doc(start[left]) == self.doc(start[left] + length - 1)]
            for k in range(1, length):  # each next list, moved by its term's offset, thins out what is left
                if not len(left):
                    break
                left = left[self.has(ranks[left, order[left, k]], start[left] + order[left, k])]
            found.append((phrase[left], start[left]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def near(self, ranks: np.ndarray, within: int) -> np.ndarray:
        """Positions of the first of these terms with every other one at most ``within`` words away in the same document, in any order."""
        if not len(ranks) or (ranks < 0).any():
            return np.zeros(0, np.int64)
        first, others = ranks[0], np.unique(ranks[1:][ranks[1:] != ranks[0]])
        others = others[np.argsort(self.counts[others], kind="stable")]

        def around(rank: int, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Range of the term's entries near each position."""
            doc = self.doc(position)
            low = np.maximum(position - within, self.doc_starts[doc])
            high = np.minimum(position + within, self.doc_starts[doc + 1] - 1)
            return np.searchsorted(self.keys, rank * (self.n + 1) + low), np.searchsorted(self.keys, rank * (self.n + 1) + high, side="right")

        if len(others) and self.counts[others[0]] < self.counts[first]:  # from the rarest term to the first ones around it
            rare = self.positions[self._lists(others[:1])[1]]
            spots = np.unique(self.positions[_expanded(*around(first, rare))[1]])
            others = others[1:]
        else:
            spots = self.positions[self._lists(ranks[:1])[1]]
        for rank in others:
            a, b = around(rank, spots)
            spots = spots[a < b]
        return spots


def _expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges: (range, number)."""
    n = ends - starts
    row = np.repeat(np.arange(len(n)), n)
    return row, starts[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Items:
    """Texts to search for, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.names = [i for i, _ in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
        self.words, self.vocabulary, firsts = _tokens(np.frombuffer(b"".join(t for _, t in items), np.uint8), offsets, 0, len(items))
        self.spans = list(zip(firsts.tolist(), firsts[1:].tolist(), strict=False))


class Windows(Items):
    """Distinct windows of a set of items, by length, with the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        super().__init__(items)
        rows: dict[int, list] = {}
        for k, (a, b) in enumerate(self.spans):
            n = min(window, b - a)
            if n > 0:
                found = np.lib.stride_tricks.sliding_window_view(self.words[a:b], n)
                rows.setdefault(n, []).append((found, np.full(len(found), k)))
        self.by_length = {}
        for n, parts in rows.items():
            phrases, inverse = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
            owner = np.concatenate([o for _, o in parts])
            order = np.lexsort((owner, inverse.ravel()))
            self.by_length[n] = (phrases, owner[order], np.searchsorted(inverse.ravel()[order], np.arange(len(phrases) + 1)))

    def matches(self, block: Block) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """By document of the block: covered intervals (start, end) and items, for documents with any."""
        spots, owners = [], []
        rank = block.ranks(self.vocabulary)
        for n, (phrases, owner, firsts) in self.by_length.items():
            phrase, start = block.phrases(rank[phrases])
            if len(start):
                doc = block.doc(start)
                spots.append(np.stack([doc, start, start + n], axis=1))
                pair = np.unique(np.stack([doc, phrase], axis=1), axis=0)
                which, at = _expanded(firsts[pair[:, 1]], firsts[pair[:, 1] + 1])
                owners.append(np.stack([pair[which, 0], owner[at]], axis=1))
        if not spots:
            return {}, {}
        spots, owners = np.concatenate(spots), np.unique(np.concatenate(owners), axis=0)
        return _by_first(spots[np.lexsort((spots[:, 1], spots[:, 0]))]), {d: o[:, 0] for d, o in _by_first(owners).items()}


def _by_first(rows: np.ndarray) -> dict[int, np.ndarray]:
    """Rows sorted by their first column, without it, by its values."""
    values, cuts = np.unique(rows[:, 0], return_index=True)
    return {int(v): part[:, 1:] for v, part in zip(values, np.split(rows, cuts[1:]), strict=True)}


def covered(spots: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals sorted by start."""
    out: list[list[int]] = []
    for a, b in spots.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


HITS = "block bigint, place int, doc_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def find_hits(index: DataFrame, items: list[tuple[str, bytes]], window: int, every: bool) -> DataFrame:
    """Matches of one set of items: per document (``every``: or only per document with any) the merged word intervals, counted
    from the document's first word, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = Windows(items, window)
        for row in array_rows(batches):
            block = Block(row)
            spots, owners = query.matches(block)
            places = np.arange(len(block.doc_ids)) if every else np.array(sorted(spots), np.int64)
            runs = [np.array(covered(spots[p]), np.int64) - block.doc_starts[p] if p in spots else np.zeros((0, 2), np.int64) for p in places.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(places), row["block"])), pa.array(places, pa.int32()), block.doc_ids.take(pa.array(places)), pa.array(np.diff(block.doc_starts)[places]),
                    *(pa.array([r[:, k] for r in runs], pa.list_(pa.int64())) for k in (0, 1)), pa.array([[query.names[i] for i in owners.get(p, ())] for p in places.tolist()], pa.list_(pa.string())),
                ],
                names=["block", "place", "doc_id", "n_words", "starts", "ends", "items"],
            )

    return index.mapInArrow(releasing(run), HITS)


def segments(text: bytes, window: int, most: int) -> Iterator[bytes]:
    """A text of over ``most`` bytes in segments of about that many that have, together, the same runs of ``window`` words: neighbours share all words of a run but one."""
    inside = np.concatenate([[0], ALPHANUMERIC[np.frombuffer(text, np.uint8)].view(np.int8), [0]])
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(text) <= most or len(starts) <= window:
        yield text
        return
    first, last = 0, 0
    while last < len(starts):
        last = min(len(starts), max(first + window, int(np.searchsorted(ends, starts[first] + most, side="right"))))
        yield text[starts[first] : ends[last - 1]]
        first = last - window + 1


def _segmented(rows: DataFrame, window: int, most: int) -> DataFrame:
    """(item, text) with long texts in segments, each in the task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = [p.decode() for p in segments(text.encode(), window, most)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["item", "text"])

    long = F.octet_length("text") > most
    return rows.filter(~long).unionByName(rows.filter(long).mapInArrow(releasing(run), "item string, text string"))


def _pieces(items: DataFrame, item: str, text: str, query_bytes: int, window: int | None = None) -> Iterator[list[tuple[str, bytes]]]:
    """Distinct (item, text) in pieces of about ``query_bytes`` bytes of text, of which the driver holds one at a time; at least one piece. With ``window`` items of over an eighth of that
    are in segments that have the same windows; without, an item is held whole."""
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    if window:
        rows = _segmented(rows, window, max(1, query_bytes // 8))
    n = max(1, -(-2 * int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))
    if n > 1:
        rows = materialize(rows.repartition(F.pmod(F.xxhash64("item", "text"), F.lit(n))).withColumn("piece", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "pieces")
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.col("piece") == k)
        yield [(r["item"], r["text"].encode()) for r in part.orderBy("item", "text").collect()]
    discard(rows)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Which words of each document lie in a run of ``window`` words that a benchmark item has too.

    Returns per document row: doc_id, n_words, n_hit, items (sorted as strings), starts and ends of the hit word runs. An item with
    fewer words than a window, but not none, is one window. Words are compared as they are, not by hashes. Null or empty texts have no words
    and no hits, null or empty items match nothing, repeated documents give repeated rows, items with equal ids count once, a null item
    id is an empty one; empty tables are allowed, other columns are not read. The benchmark is matched in pieces of about ``query_bytes`` bytes
    of text, one pass over the index each, so neither the driver nor a task holds more of it whatever its size; the results of a
    pass are stored before the next begins."""
    index = materialize(build_index(docs, key, text), "postings")
    stored = []
    pieces = _pieces(benchmark, item, item_text, query_bytes, window)
    piece = next(pieces)
    for following in pieces:
        stored.append(materialize(find_hits(index, piece, window, False), "hits"))
        piece = following
    if not stored:
        return _counted(find_hits(index, piece, window, True))
    stored.append(materialize(find_hits(index, piece, window, False), "hits"))
    found = docs.sparkSession.read.schema(HITS).parquet(*(t.stored_at for t in stored))
    merged = found.groupBy("block", "place").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("_runs"), F.flatten(F.collect_list("items")).alias("_items"))
    runs = F.aggregate(
        "_runs",
        F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["ends"] >= x["starts"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["starts"].alias("starts"), F.greatest(F.try_element_at(acc, F.lit(-1))["ends"], x["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(x))),
    )
    every = find_hits(index, [], window, True).select("block", "place", "doc_id", "n_words")
    return _counted(
        every.join(merged.select("block", "place", runs.alias("_runs"), "_items"), ["block", "place"], "left").select(
            "doc_id", "n_words", F.coalesce(F.col("_runs.starts"), F.expr("cast(array() as array<bigint>)")).alias("starts"), F.coalesce(F.col("_runs.ends"), F.expr("cast(array() as array<bigint>)")).alias("ends"), F.coalesce("_items", F.expr("cast(array() as array<string>)")).alias("items")
        )
    )


def _counted(hits: DataFrame) -> DataFrame:
    total = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return hits.select("doc_id", "n_words", total.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "starts", "ends")


NEAR = "doc_id bigint, item string, positions array<bigint>"


def proximity(docs: DataFrame, items: DataFrame, within: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Where documents have all words of an item close together, in any order.

    Returns a row (doc_id, item, positions) for each document row and distinct item that match: the positions, counted in words from the
    document's first, of the item's first word with every other word of the item at most ``within`` words away. Items without words match
    nothing; null and empty texts match nothing; repeated documents give repeated rows, null keys and ids are passed on (an item's as an empty
    string); empty tables are allowed; other columns are not read. As in ``contamination`` items are searched in pieces of bounded size."""
    index = materialize(build_index(docs, key, text), "postings")

    def search(piece: list[tuple[str, bytes]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query = Items(piece)
            schema = pa.schema([("doc_id", pa.int64()), ("item", pa.string()), ("positions", pa.list_(pa.int64()))])
            for row in array_rows(batches):
                block, rows = Block(row), []
                rank = block.ranks(query.vocabulary)
                for name, (a, b) in zip(query.names, query.spans, strict=True):
                    spots = block.near(rank[query.words[a:b]], within)
                    if len(spots):
                        found = _by_first(np.stack([block.doc(spots), spots], axis=1))
                        rows += [{"doc_id": block.doc_ids[d].as_py(), "item": name, "positions": x[:, 0] - block.doc_starts[d]} for d, x in found.items()]
                yield pa.RecordBatch.from_pylist(rows, schema)

        return index.mapInArrow(releasing(run), NEAR)

    stored = [materialize(search(piece), "near") for piece in _pieces(items, item, item_text, query_bytes)]
    discard(index)
    return docs.sparkSession.read.schema(NEAR).parquet(*(t.stored_at for t in stored))


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest instead of the lists."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same rows as ``digest`` from plain loops; for tests."""
    import re

    def split(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    out = []
    for doc, text in docs:
        have, hit, got = split(text), set(), set()
        for name, item in items:
            want = split(item)
            n = min(window, len(want))
            grams = {tuple(want[i : i + n]) for i in range(len(want) - n + 1)} if n else set()
            for i in range(len(have) - n + 1) if grams else ():
                if tuple(have[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    got.add(name)
        names = ",".join(sorted(got))
        out.append((doc, len(have), len(hit), len(got), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(have)))
    return out

"""Near-duplicate classes: fast similarity sketches, banding, exact verification, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import FOLD, NOT_BLANK, chunks, mix, releasing, text_shingles, text_slices, whole_key, word_codes
from webloom.storage import discard, materialize

#: Members of a block; two blocks meet in one task when members of a bucket need a second look.
BLOCK = 4096

#: Members that meet one copy of their leader, and band keys (of so many rows, at most) that are joined without a shuffle.
MEMBERS, MOST_HOT, HOT_ROWS = 64, 4096, 1000

#: Links that are few enough for one task.
LAST_LINKS = 1 << 16

#: Bytes of text that are turned into sketches, or compared, at a time.
TEXT_AT_ONCE = 1 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def exact_sets(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, width: int) -> list[np.ndarray]:
    """Shingle sets of texts i to j - 1, as ascending numbers that are equal, within one call, exactly where the words are."""
    numbers, cuts = text_shingles(raw, offsets, i, j, width, NOT_BLANK, FOLD)[0].sets()
    return [numbers[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def hashed_sets(raw: np.ndarray, offsets: np.ndarray, i: int, j: int, width: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Shingle sets of texts i to j - 1 as hashes in ascending order, and a 128-bit digest of each set.

    Words enter by a cryptographic digest, so that no text can be made to look like another."""
    found, vocabulary = text_shingles(raw, offsets, i, j, width, NOT_BLANK, FOLD)
    codes = word_codes(vocabulary)
    first, second = (found.hashes(codes[:, k]) for k in (0, 1))
    order = np.argsort(first)
    if (first[order[1:]] == first[order[:-1]]).any():  # the order must not depend on what else is hashed with a text
        order = np.lexsort((second, first))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ranks, cuts = found.sets(rank[found.number])
    both = np.stack([first[order], second[order]], axis=1)
    sets = [ranks[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [both[s, 0] for s in sets], [hashlib.blake2b(both[s].tobytes(), digest_size=16).digest() for s in sets]


def fast_sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``size`` coordinates per non-empty set (an empty set's row stays EMPTY).

    In round i every element is thrown into a hashed bin; in rounds size to 2 * size - 1 into bin i - size, so that each bin fills at
    last. A coordinate keeps the least (round, hash) seen; a set stops taking part once all its bins are filled."""
    out = np.full((len(sets), size), EMPTY, np.uint64)
    active = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(active):
        return out
    values, owners = np.concatenate([sets[k] for k in active]), np.repeat(active, [len(sets[k]) for k in active])
    flat = out.reshape(-1)
    for step in range(2 * size):
        h = mix(values ^ mix(np.array([step + 1], np.uint64))[0])
        bins = ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32) if step < size else np.full(len(h), step - size, np.uint64)
        np.minimum.at(flat, owners * size + bins.astype(np.int64), (np.uint64(step) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        open_ = np.zeros(len(sets), bool)
        left = owners[np.concatenate([[True], owners[1:] != owners[:-1]])]
        open_[left] = (out[left] == EMPTY).any(axis=1)
        if not open_.any():
            break
        if not open_[left].all():
            keep = open_[owners]
            values, owners = values[keep], owners[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    keys = np.zeros((len(sketch), bands), np.uint64)
    for k in range(bands):
        acc = np.full(len(sketch), k + 1, np.uint64)
        for r in range(rows):
            acc = mix(acc ^ sketch[:, k * rows + r]) + np.uint64(r)
        keys[:, k] = acc
    return keys


SIGNATURES = "doc_id bigint, tag binary, n_shingles bigint, h1 bigint, h2 bigint, keys array<bigint>, sketch binary"


def tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Ids and texts, and a digest that tells different texts of one id apart."""
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16).alias("tag"), F.col(text).alias("text"))


def signatures(docs: DataFrame, width: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """Set size, 128-bit set digest, band keys and the sketch (16 bits a coordinate) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_slices(batch.column("text"))
            for i, j in chunks(offsets, TEXT_AT_ONCE):
                sets, digests = hashed_sets(raw, offsets, i, j, width)
                sketch = fast_sketches(sets, bands * rows)
                keys = band_keys(sketch, bands, rows).view(np.int64)
                small = mix(sketch).astype("<u2")
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("tag"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                        pa.array([k.tolist() if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                        pa.array([k.tobytes() if len(s) else None for k, s in zip(small, sets, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "tag", "n_shingles", "h1", "h2", "keys", "sketch"],
                )

    return tagged(docs, key, text).mapInArrow(releasing(run), SIGNATURES)


def least_agreement(size: int, similarity: float) -> int:
    """Agreeing coordinates that a pair at the threshold has but for a chance of about 1e-9 (6 standard deviations), far below the chance
    that banding misses it."""
    return max(1, int(size * similarity - 6 * (size * similarity * (1 - similarity)) ** 0.5))


def met(pairs: DataFrame, side: DataFrame, column: str, run: Callable[[pa.Table, np.ndarray], np.ndarray], result: str) -> DataFrame:
    """(a, b, ``result``) for pairs (a, b), from ``side`` (id and a column of each).

    A leader a and its members meet in the same task, the leader's row first, so that its column is sent once and not once a member. A leader
    of many is sent once for each MEMBERS of them, to different tasks. ``run`` gets rows and, for each, which row is its leader."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("_parts"))
    own = side.select("id", F.col(column).alias("_x"))
    leaders = many.join(own.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_member"), F.col("a").alias("b"), "_x")
    members = pairs.select("a", "b").join(many, "a").join(own.withColumnRenamed("id", "b"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("_part"), F.lit(1).alias("_member"), "b", "_x")
    rows = leaders.unionByName(members).repartition("a", "_part").sortWithinPartitions("a", "_part", "_member")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            table = table.combine_chunks()
            is_leader = table["_member"].to_numpy() == 0
            leader = np.maximum.accumulate(np.where(is_leader, np.arange(len(is_leader)), -1))
            last = table.slice(int(leader[-1]), 1).to_batches()[0]
            found = run(table, leader)
            keep = pa.array(~is_leader)
            out = pa.table([table["a"], table["b"], pa.array(found)], names=["a", "b", result]).filter(keep)
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(releasing(inner), f"a bigint, b bigint, {result} boolean")


def agreeing(pairs: DataFrame, sketches: DataFrame, size: int, least: int) -> DataFrame:
    """Those (a, b) whose sketches agree in at least ``least`` coordinates."""

    def run(table: pa.Table, leader: np.ndarray) -> np.ndarray:
        sketch = np.frombuffer(b"".join(table["_x"].to_pylist()), "<u2").reshape(-1, size)
        return (sketch == sketch[leader]).sum(axis=1) >= least

    return met(pairs, sketches, "sketch", run, "agree").filter("agree").select("a", "b")


def is_link(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sets of ascending numbers have 100 * intersection >= percent * union, and anything in common."""
    if len(one) > len(other):
        one, other = other, one
    if 100 * len(one) < percent * len(other) or not len(one):
        return False
    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
    both = int((other[at] == one).sum())
    return both > 0 and 100 * both >= percent * (len(one) + len(other) - both)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) with ``linked`` decided on the words of the full shingle sets: 100 * intersection >= percent * union."""

    def run(table: pa.Table, leader: np.ndarray) -> np.ndarray:
        column = table["_x"].combine_chunks()
        out = np.zeros(len(leader), bool)
        offsets = text_slices(column)[1]
        for i, j in chunks(offsets, TEXT_AT_ONCE):
            head = int(leader[i])  # a leader whose members go on here comes along
            part = column.slice(i, j - i) if head == i else pa.concat_arrays([column.slice(head, 1), column.slice(i, j - i)])
            shift = 0 if head == i else 1
            own, bounds = text_slices(part)
            sets = exact_sets(own, bounds, 0, len(part), width)
            for k in range(i, j):
                if leader[k] != k:
                    out[k] = is_link(sets[0 if leader[k] < i else leader[k] - i + shift], sets[k - i + shift], percent)
        return out

    return met(pairs, texts, "text", run, "linked")


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, to) for every end of all links (a, b): the least id that can be reached."""
    parts = list(batches)
    if parts:
        links = pa.Table.from_batches(parts)
        a, b = links["a"].to_numpy(), links["b"].to_numpy()
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[_labels(len(ids), ends[: len(a)], ends[len(a) :])])], names=["id", "to"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of the links (a, b): component is one of the ids that can be reached, the same for all of them.

    Every node is merged into its least neighbour (or stays, if it is less itself), links are rewritten to what their ends became, and so
    on until none is left. What is least changes: in even rounds the least id, which contracts stars at once, in odd rounds the least by a
    hash of the id and the round, followed for up to four steps. By such an order at most half of the nodes that have neighbours are expected
    to stay, so rounds grow with the logarithm of the longest chain. A round costs one aggregation and a few joins over the links left; the
    last LAST_LINKS of them, a megabyte, are followed to their ends in one task."""
    steps, left = [], materialize(links.select("a", "b").filter("a <> b"), "links")
    while count := left.count():
        turn = len(steps)
        if count <= LAST_LINKS:
            steps.append(materialize(left.repartition(1).mapInArrow(followed, "id bigint, to bigint"), "step"))
            break

        def rank(c, turn=turn):
            return F.struct((F.xxhash64(c, F.lit(turn)) if turn % 2 else F.lit(0).cast("bigint")).alias("h"), c.alias("id"))

        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("id")).agg(F.min(rank(F.col("b"))).alias("_low")).select("id", F.least("_low", rank(F.col("id")))["id"].alias("to"))
        step = materialize(step, "step")
        if turn % 2:
            before = step
            for _ in range(2):
                step = step.join(step.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to"))
            step = materialize(step, "step")
            discard(before)
        steps.append(step)
        a, b = step.select(F.col("id").alias("a"), F.col("to").alias("_a")), step.select(F.col("id").alias("b"), F.col("to").alias("_b"))
        before = left
        left = materialize(left.join(a, "a").join(b, "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "links")
        discard(before)
    discard(left)
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    found = steps[-1].select("id", F.col("to").alias("component"))
    for step in reversed(steps[:-1]):  # the last and smallest first
        found = step.join(found.select(F.col("id").alias("to"), F.col("component").alias("_further")), "to", "left").select("id", F.coalesce("_further", "to").alias("component"))
    out = materialize(found, "components")
    discard(*steps)
    return out


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by ``by``, in tables of whole groups, with where each group begins (and the end)."""
    carry = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if carry is not None:
            rows = pa.concat_tables([carry, rows])
        change = np.zeros(max(rows.num_rows - 1, 0), bool)
        for c in by:
            v = rows[c].to_numpy()
            change |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts
        carry = rows.slice(int(starts[-1]))
    if carry is not None and carry.num_rows:
        yield carry, np.array([0, carry.num_rows])


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of n nodes can reach over edges i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def in_components(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with their component, and main, the component of the bucket's leader."""
    own = found.select(F.col("id").alias("member"), "component")
    lead = found.select(F.col("id").alias("leader"), F.col("component").alias("main"))
    return buckets.join(own, "member", "left").join(lead, "leader", "left").select("key", "leader", "member", F.coalesce("component", "member").alias("component"), F.coalesce("main", "leader").alias("main"))


def open_groups(rows: DataFrame) -> DataFrame:
    """Rows (key, member, component, main, ...) of keys whose members are in several components, with how many are outside the main one."""
    few = F.count_if(F.col("component") != F.col("main"))
    open_ = rows.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), few.alias("_few")).filter("_low <> _high")
    return rows.join(open_.select("key", "_few"), "key")


def second_look(buckets: DataFrame, found: DataFrame, sketches: DataFrame, size: int, least: int, percent: int) -> DataFrame:
    """(gid, member, component): groups of members of one bucket whose sketches tie them together though they are in different components.

    Every member has met its bucket's leader, so only the others are looked at, and only where they are in several components. Where
    more than BLOCK of them are outside the leader's component, the bucket is split by set sizes: linked sets differ by ``percent`` at most, so
    a part has the members of two neighbouring steps of a scale with that ratio, and each pair that can be a link is in one part. What is
    still too large is dealt into blocks of about BLOCK; every two blocks meet in one task, but for two that are both from the leader's
    component. So every pair of a bucket that can join components is looked at, however large the bucket is.
    What leaves a task is not pairs but, for each set of members that agreeing pairs connect, one row per member; a set that
    several buckets show gets the same gid from its members and is kept once."""
    members = in_components(buckets, found).filter("leader <> member")
    own = materialize(open_groups(members.select("key", "member", "component", "main")).withColumn("upper", F.lit(False)), "open")
    stored, rows, large = [own], own, own.filter(F.col("_few") > BLOCK)
    if not large.isEmpty():
        step = math.log(100 / percent) * (1 + 1e-9) + 1e-9 if percent else math.inf
        place = F.floor(F.log("n_shingles") / F.lit(step))
        parts = large.join(sketches.select(F.col("id").alias("member"), "n_shingles"), "member").withColumn("place", place).withColumn("part", F.explode(F.array("place", F.col("place") + 1)))
        parts = parts.select(F.xxhash64("key", "part").alias("key"), "member", "component", "main", (F.col("place") == F.col("part")).alias("upper"))
        stored.append(materialize(open_groups(parts), "open"))
        rows = own.filter(F.col("_few") <= BLOCK).unionByName(stored[1])
    rows = rows.drop("_few").withColumn("minor", F.col("component") != F.col("main"))
    counts = rows.groupBy("key").agg(F.sum(F.col("minor").cast("int")).alias("_few"), F.sum((~F.col("minor")).cast("int")).alias("_many"))
    rows = rows.join(counts.select("key", F.ceil(F.col("_few") / BLOCK).cast("int").alias("_few"), F.ceil(F.col("_many") / BLOCK).cast("int").alias("_many")), "key")
    spread = F.pmod(F.xxhash64("member"), F.when(F.col("minor"), F.col("_few")).otherwise(F.col("_many"))).cast("int") + F.when(F.col("minor"), F.col("_many")).otherwise(0)
    every, small = F.sequence(F.lit(0), F.col("_many") + F.col("_few") - 1), F.sequence(F.col("_many"), F.col("_many") + F.col("_few") - 1)
    rows = rows.withColumn("block", spread).withColumn("other", F.explode(F.when(F.col("minor"), every).otherwise(small)))
    rows = rows.select("key", F.least("block", "other").alias("_p"), F.greatest("block", "other").alias("_q"), "block", "member", "component", "upper")
    rows = rows.join(sketches.select(F.col("id").alias("member"), "n_shingles", "sketch"), "member")

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["key", "_p", "_q"]):
            ids, comp, n, p, q, block, upper = (table[c].to_numpy() for c in ("member", "component", "n_shingles", "_p", "_q", "block", "upper"))
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), "<u2").reshape(-1, size)
            sizes = np.diff(starts)
            firsts = starts[:-1]
            end = np.repeat(firsts + sizes, sizes)
            few = np.repeat(sizes <= 32, sizes)
            edges_i, edges_j = [], []

            def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return (comp[i] != comp[j]) & ~(upper[i] & upper[j]) & ((p[i] == q[i]) | (block[i] != block[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))

            for step in range(1, 32):  # small groups: all neighbours at one distance at a time
                i = np.flatnonzero(few & (np.arange(len(ids)) + step < end))
                if not len(i):
                    break
                i = i[fits(i, i + step)]
                i = i[(sketch[i] == sketch[i + step]).sum(axis=1) >= least]
                edges_i.append(i)
                edges_j.append(i + step)
            for first, count in zip(firsts[sizes > 32], sizes[sizes > 32], strict=True):
                own = np.arange(first, first + count)
                one = p[first] == q[first]
                for i in own if one else own[block[own] == p[first]]:
                    j = own[own > i] if one else own[block[own] == q[first]]
                    j = j[fits(np.full(len(j), i), j)]
                    j = j[(sketch[j] == sketch[i]).sum(axis=1) >= least]
                    edges_i.append(np.full(len(j), i))
                    edges_j.append(j)
            i, j = (np.concatenate(e).astype(np.int64) if e else np.zeros(0, np.int64) for e in (edges_i, edges_j))
            label = _labels(len(ids), i, j)
            kept = np.unique(np.concatenate([i, j]))
            own = label[kept]
            code = np.zeros(len(ids), np.uint64)
            np.add.at(code, own, mix(ids[kept].view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(code[own].view(np.int64)), pa.array(ids[kept]), pa.array(comp[kept])], names=["gid", "member", "component"])

    ties = rows.repartition("key", "_p", "_q").sortWithinPartitions("key", "_p", "_q").mapInArrow(releasing(tied), "gid bigint, member bigint, component bigint")
    out = materialize(ties.dropDuplicates(["gid", "member"]), "groups")
    discard(*stored)
    return out


def shared_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of 0/1 matrices over the elements that several sets have, some columns at a time."""
    m = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    column = np.cumsum(first) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    out = np.zeros((m, m), np.float32)
    n = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, n, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((m, min(4096, n - a)), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out


def _joining(ids: np.ndarray, own: np.ndarray, linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) among those in a table of rows by columns, as many as it takes to join what they join; ``own`` is each one's part,
    rewritten as parts are joined."""
    out = []
    for i, row in zip(rows, linked, strict=True):
        for j in columns[row & (own[columns] != own[i])]:
            if own[j] != own[i]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                own[own == own[j]] = own[i]
    return out


def links_in_groups(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between members of different components of one group, decided on the words of full shingle sets; of all links of a group as
    many as it takes to join what they join, so rows grow with members and not with pairs. Of a group with long texts, some are
    compared at a time."""
    rows = groups.join(texts.select(F.col("id").alias("member"), "text"), "member").repartition("gid").sortWithinPartitions("gid", "member")

    def linked(raw: np.ndarray, offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        """Which texts of the first span are linked with which of all."""
        view = memoryview(raw)
        parts = [view[offsets[k] : offsets[k + 1]] for a, b in spans for k in range(a, b)]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        sets = exact_sets(np.frombuffer(b"".join(parts), np.uint8), bounds, 0, len(parts), width)
        n = np.array([len(s) for s in sets], np.float64)
        both = shared_sizes(sets)
        return ((100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0))[: spans[0][1] - spans[0][0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches, ["gid"]):
            raw, offsets = text_slices(table["text"])
            ids, comp = table["member"].to_numpy(), table["component"].to_numpy()
            found: list[tuple[int, int]] = []
            for a, b in zip(starts, starts[1:], strict=False):
                own = np.unique(comp[a:b], return_inverse=True)[1]
                spans = [(a + i, a + j) for i, j in chunks(offsets[a : b + 1], 4 * TEXT_AT_ONCE)]
                for x, one in enumerate(spans):
                    for other in spans[x:]:
                        both = [one] if one == other else [one, other]
                        columns = np.concatenate([np.arange(i, j) for i, j in both]) - a
                        found += _joining(ids[a:b], own, linked(raw, offsets, both), np.arange(*one) - a, columns)
            x = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return rows.mapInArrow(releasing(run), "a bigint, b bigint")


def bucketed(classes: DataFrame) -> DataFrame:
    """(key, leader, member) of band keys that several classes have; the leader is the one with the least document, as a first text is
    often what later ones were made from.

    Keys with a great many members, of which there are at most MOST_HOT, are joined by broadcast, so that their rows stay where they are."""
    banded = classes.select("id", "doc_id", F.explode("keys").alias("key"))
    total = classes.agg(F.sum(F.size("keys"))).first()[0] or 0
    leaders = materialize(banded.groupBy("key").agg(F.min(F.struct("doc_id", "id")).alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key", F.col("_least.id").alias("leader"), "_n"), "leaders")
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot, cold = leaders.filter(F.col("_n") > limit).drop("_n"), leaders.filter(F.col("_n") <= limit).drop("_n")
    banded = banded.drop("doc_id")
    rest = banded.join(F.broadcast(hot.select("key")), "key", "left_anti")
    found = banded.join(F.broadcast(hot), "key").unionByName(rest.join(cold, "key"), allowMissingColumns=False)
    out = materialize(found.select("key", "leader", F.col("id").alias("member")), "buckets")
    discard(leaders)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int | None = None, rows: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept (doc_id = component_id) per document row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set is the distinct runs of ``width`` words (fewer words: all of them as one).
    Two documents are linked if 100 * intersection >= percent * union on full sets of words. Null, empty and blank texts have empty sets and
    are linked with nothing; a null id is its own class; rows of one id are compared each by its own text; an empty table gives no rows; other
    columns are not read.

    Equal sets (by a 128-bit cryptographic digest) are one class from the start, so copies cost one row each. Of other texts, all that
    share a band key with their bucket's leader are compared with that one (a star, not all pairs). Buckets whose other members still are in
    different components get a second look across components only, by sketches, and what those tie together is decided on full
    sets group by group. Ids that are no integers are refused."""
    whole_key(docs, key)
    if bands is None or rows is None:
        bands, rows = (25, 5) if percent >= 85 else (31, 4)
    size = bands * rows
    least = least_agreement(size, percent / 100)
    sig = materialize(signatures(docs, width, bands, rows, key, text), "signatures")
    classes = sig.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "tag")).alias("own"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "n_shingles", "own.doc_id", "own.tag", "keys", "sketch"), "classes")
    buckets = bucketed(classes)
    sharing = buckets.select(F.col("member").alias("id")).distinct()
    sketches = materialize(classes.select("id", "doc_id", "tag", "n_shingles", "sketch").join(sharing, "id", "left_semi"), "sketches")
    texts = materialize(tagged(docs, key, text).join(sketches.select("id", "doc_id", "tag"), ["doc_id", "tag"]).select("id", "text").dropDuplicates(["id"]), "texts")
    stars = buckets.filter("leader <> member").select(F.col("leader").alias("a"), F.col("member").alias("b")).distinct()
    near = materialize(agreeing(stars, sketches, size, least), "near")
    links = materialize(verified(near, texts, width, percent).filter("linked").select("a", "b"), "links")
    found = components(links)
    groups = second_look(buckets, found, sketches, size, least, percent)
    more = None if groups.isEmpty() else materialize(links_in_groups(groups, texts, width, percent), "more")
    if more is not None and not more.isEmpty():
        discard(found)
        found = components(links.unionByName(more))
    discard(buckets, sketches, texts, near, links, groups, more)
    own = found.join(classes.select("id", "doc_id"), "id")
    low = own.groupBy("component").agg(F.min("doc_id").alias("_component"))
    labels = classes.select("h1", "h2", "n_shingles", "id", "doc_id").join(found.join(low, "component").select("id", "_component"), "id", "left").select("h1", "h2", "n_shingles", F.coalesce("_component", "doc_id").alias("_component"))
    return sig.select("doc_id", "n_shingles", "h1", "h2").join(labels, ["h1", "h2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("_component")), F.col("doc_id")).alias("component_id"),
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("_component") == F.col("doc_id")), F.lit(True)).alias("kept"),
    )


def brute_force(docs: list[tuple[int, str | None]], width: int, percent: int) -> list[tuple[int, int, int, bool]]:
    """The same rows from plain loops over all pairs; for tests."""
    import re

    sets = []
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    where: dict = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    root = list(range(len(docs)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for other in where[x]:
                if other < k:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                root[top(k)] = top(other)
    least: dict[int, int] = {}
    for k, (doc, _) in enumerate(docs):
        least[top(k)] = min(least.get(top(k), doc), doc)
    return [(doc, len(sets[k]), least[top(k)], doc == least[top(k)]) for k, (doc, _) in enumerate(docs)]

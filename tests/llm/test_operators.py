"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.conftest import DATA  # noqa: E402
from webloom.llm import audio, contamination, html_text, neardup, packing, pii, quality, sharding, suffix_dedup  # noqa: E402
from webloom.llm.tokens import Encoder  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the of and ñandú Ärger été alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def texts(seed=1, n=40):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randint(1, 120))) for _ in range(n)]
    out = []
    for k, t in enumerate(base):
        out.append(t)
        if k % 3 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            out.append(" ".join(w))
        if k % 4 == 0:
            out.append(t)
    return out + ["", "   \n\t", "x", "one two", "A" * 5000, "é" * 3000, " ".join(["word"] * 30000)]


@pytest.fixture(scope="module")
def rows():
    found = [(k, t) for k, t in enumerate(texts())]
    return [*found, (len(found), None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    extra = [(i, t, "n", 1, 2, "s") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id bigint, text string, score string, n_bytes int, `_text` int, ids string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_sharding(docs, rows, empty):
    got = {r["doc_id"]: r for r in sharding.shard(docs).collect()}
    assert len(got) == len(rows) and sharding.shard(empty).count() == 0

    def jump(key, n):
        b, j = -1, 0
        key %= 1 << 64
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    for i, t in rows:
        r = got[i]
        assert (r["shard"], r["grown_shard"], r["size"], r["text_crc32"]) == (jump(i, 8), jump(i, 9), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    for s in range(8):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))


def check_slots(got):
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_repeated_negative_and_null_keys(spark):
    df = spark.createDataFrame([(-5, "a"), (-5, "a"), (None, None), (1 << 62, "b")], "doc_id bigint, text string")
    got = sharding.shard(df).collect()
    assert len(got) == 4
    check_slots(got)


def test_sharding_of_wide_skewed_and_other_keys(spark, monkeypatch):
    """Keys over the whole range, one far from the rest, one key with a third of all rows, and keys that are texts."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 4)
    keys = [-(2**63), 2**63 - 1, 2**62, *range(400), *[7] * 200]
    df = spark.createDataFrame([(k, f"t{i % 150}") for i, k in enumerate(keys)], "doc_id bigint, text string").repartition(4)
    got = sharding.shard(df).collect()
    check_slots(got)
    assert len(got) == len(keys) and sum(r["doc_id"] == 7 for r in got) == 201 and len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    named = spark.createDataFrame([(f"k{i % 90}" if i % 10 else None, "x", "s") for i in range(300)], "name string, text string, shard string")
    found = sharding.shard(named, key="name").collect()
    check_slots(found)
    shards = {}
    for r in found:
        shards.setdefault(r["name"], set()).add((r["shard"], r["grown_shard"]))
    assert all(len(v) == 1 for v in shards.values()) and len(found) == 300
    assert all(s == g or g == 8 for v in shards.values() for s, g in v) and len({s for v in shards.values() for s, _ in v}) > 4


def test_encoder_matches_the_library(rows):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(BPE), Encoder(BPE)
    for _, t in [*rows, (0, "a  b\n\n c <|endoftext|> d's 12³ 的字 x")]:
        assert fast(t).tolist() == slow.encode(t or "", add_special_tokens=False).ids
    assert fast.fast is not None


def ids_of(rows, end):
    encode = Encoder(BPE)
    return {i: [*encode(t).tolist(), end] for i, t in rows}


def test_online_packing(docs, rows, empty):
    got = packing.pack_online(docs, BPE, capacity=64, limit=3).collect()
    want = ids_of(rows, 0)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u2").tolist()))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    for i, w in want.items():
        assert [x for _, p in sorted(by_doc[i]) for x in p] == w
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_online(empty, BPE).count() == 0


def test_checksums_of_wide_ids(spark, monkeypatch):
    from webloom.llm import queries, tokens

    ids = np.array([70000, 1, 2**31], "<u4")
    df = spark.createDataFrame([(1, 0, 3, bytearray(ids.tobytes()), 3, 0, 0)], "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    monkeypatch.setattr(queries, "stored_type", lambda _: tokens.id_type(1 << 17))
    assert queries.checksums(df).first()["ids_crc32"] == zlib.crc32(ids.tobytes())
    assert tokens.stored_type(BPE) == Encoder(BPE).dtype


def test_packing_of_repeated_rows_and_null_keys(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, sequence_id string").repartition(3)
    got = packing.pack_online(df, BPE, capacity=16).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 1, 2] and sum(r["length"] for r in got) == sum(len(Encoder(BPE)(t)) + 1 for _, t in rows)
    found = packing.unpack_blocks(packing.pack_blocks(df, BPE, capacity=16)).collect()
    assert sorted((r["doc_id"] or 0) for r in found) == [0, 0, 1, 1, 2]


def test_leftovers_of_many_partitions_merge(spark):
    df = spark.createDataFrame([(k, "a b c") for k in range(300)], "doc_id bigint, text string").repartition(40)
    got = packing.pack_online(df, BPE, capacity=1024).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) == 2 and max(r["n"] for r in got) <= 1024


def test_block_packing(docs, rows, empty):
    packed = packing.pack_blocks(docs, BPE, capacity=128, block_ids=4000)
    want = ids_of(rows, 50256)
    parts = {}
    for r in packing.unpack_blocks(packed).collect():
        parts.setdefault(r["doc_id"], {})[r["start"]] = np.frombuffer(r["ids"], "<u2").tolist()
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in parts.items()} == want
    for r in packed.collect():
        assert len(r["ids"]) == 256 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128
        positions = np.frombuffer(r["position_ids"], "<u2")
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert positions[a:b].tolist() == list(range(b - a))
    assert packing.pack_blocks(empty, BPE).count() == 0


def test_stored_matrices(spark, docs, empty, tmp_path):
    packed = packing.pack_blocks(docs, BPE, capacity=128, block_ids=4000)
    packing.write_matrices(packed, str(tmp_path / "m"), sequences=7)
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert all(len(r["ids"]) == len(r["sequence_ids"]) * 256 and len(r["sequence_ids"]) <= 7 for r in stored.collect())
    back = packing.read_matrices(spark, str(tmp_path / "m"))
    assert back.columns == packed.columns
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, packed.collect()), key=repr)
    packing.write_matrices(packing.pack_blocks(empty, BPE), str(tmp_path / "e"))
    assert packing.read_matrices(spark, str(tmp_path / "e")).count() == 0


def test_best_fit_decreasing_against_a_plain_search():
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 50) for _ in range(400)]
    rooms, want = [], [[] for _ in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        if fit:
            b = min(fit)[1]
        else:
            b = len(rooms)
            rooms.append(50)
        rooms[b] -= sizes[i]
        want[b].append(i)
    got = packing.best_fit_decreasing(sizes, 50)
    assert len(got) == len(rooms) and sorted(i for b in got for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 50 for b in got)


@pytest.mark.parametrize("query_bytes", [1 << 20, 200])
def test_contamination(spark, docs, rows, query_bytes):
    pool = [t for _, t in rows if t and len(t.split()) > 20]
    items = [("b", " ".join(pool[0].split()[3:18])), ("a", pool[1].upper()), ("c", "x"), ("d", ""), ("e", None), ("f", "one two"), ("g", " ".join(pool[2].split()[:12]) + " unseen"), ("a", pool[3])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(tuple(r) for r in contamination.digest(contamination.contamination(docs, bench, query_bytes=query_bytes)).collect())
    merged = contamination.brute_force(rows, items)
    assert got == sorted(merged)
    assert any(r[5] for r in got)


def test_contamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    assert contamination.contamination(empty, none).count() == 0
    assert contamination.digest(contamination.contamination(docs, none)).filter("n_hit > 0 or contaminated").count() == 0


def test_phrases(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "c x a y b"), (3, "a b")], "doc_id bigint, text string")
    block = contamination.Block(contamination.build_index(df.coalesce(1)).first().asDict())
    items = contamination.Items([("", b"a b c")])
    ranks = block.ranks(items.vocabulary)
    phrase, start = block.phrases(ranks[items.words[None, :2]])
    assert block.doc(start).tolist() == [0, 2] and phrase.tolist() == [0, 0]
    assert sorted(set(block.doc(block.near(ranks[items.words], 4)).tolist())) == [0, 1]


@pytest.mark.parametrize("query_bytes", [1 << 20, 30])
def test_proximity(spark, query_bytes):
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choices("abcdefghij", k=rnd.randint(0, 60)))) for k in range(40)] + [(None, "a b"), (3, "a b"), (3, "a b"), (50, None), (51, "")]
    items = [(f"q{k}", " ".join(rnd.choices("abcdefghijk", weights=[9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0.2], k=rnd.randint(0, 4)))) for k in range(25)] + [("x", None), ("q1", "j"), (None, "a b")]
    got = contamination.proximity(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string"), within=4, query_bytes=query_bytes)
    want = []
    for doc, text in rows:
        have = (text or "").split()
        for name, item in set(items):
            words = (item or "").split()
            at = [p for p, w in enumerate(have) if words and w == words[0] and all(x in have[max(0, p - 4) : p + 5] for x in words)]
            if at:
                want.append((doc, name or "", at))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect()) and want


def thue_morse():
    """Two different words that polynomial hashes modulo a power of two take for equal, whatever their base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return one, one.translate({97: 98, 98: 97})


def test_planted_words_do_not_collide(spark):
    one, other = thue_morse()
    rows = [(1, f"{one} x y"), (2, f"{other} x y"), (3, one), (4, other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = [("i", one), ("j", f"{other} x")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert sorted(tuple(r) for r in contamination.digest(contamination.contamination(docs, bench)).collect()) == sorted(contamination.brute_force(rows, items))
    for width, percent in ((3, 85), (5, 80)):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width, percent).collect())
        assert got == neardup.brute_force(rows, width, percent) and all(r[3] for r in got)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, width, percent):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width, percent).collect())
    assert got == neardup.brute_force(rows, width, percent)
    assert neardup.near_duplicates(empty, width, percent).count() == 0


def test_near_duplicates_without_a_centre(spark):
    """Chains and rings whose least member is not linked with all: the second look has to find their links."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k % 12):
            w[(7 * k + 11 * j) % 120] = f"r{rnd.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect())
    assert got == neardup.brute_force(rows, 3, 85)


def test_near_duplicates_of_reused_ids_and_repeated_rows(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " end"), (3, b + " end"), (3, c), (3, c), (None, a), (9, c), (9, ""), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    want = [(5, 36, 5, True), (5, 36, 3, False), (7, 37, 5, False), (3, 37, 3, True), (3, 36, 3, True), (3, 36, 3, True), (None, 36, None, True), (9, 36, 3, False), (9, 0, 9, True), (None, 0, None, True)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """One band key for all: the second look splits by further keys, and deals what is left into blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 6)
    monkeypatch.setattr(neardup, "LAST_LINKS", 5)
    monkeypatch.setattr(neardup, "HOT_ROWS", 3)
    monkeypatch.setattr(neardup, "MOST_HOT", 4)
    rnd = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(50):
        own = [f"g{k // 2}x{j}" for j in range(50)]
        own[rnd.randrange(50)] = f"v{k}"
        rows.append((k, " ".join(common + own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for width, percent in ((3, 85), (5, 80)):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, width, percent).collect())
        assert got == neardup.brute_force(rows, width, percent)


@pytest.mark.parametrize(("percent", "sizes"), [(85, [(17, 20), (85, 100), (1700, 2000), (7, 7)]), (80, [(4, 5), (80, 100), (5242, 6552)]), (100, [(9, 9), (1000, 1000)])])
def test_second_look_asks_for_no_further_key(spark, monkeypatch, percent, sizes):
    """Pairs of a large bucket that share its key alone, with sizes at the least ratio that a link can have."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rnd, size = np.random.default_rng(3), 20
    rows = [(0, 50, rnd.bytes(2 * size))]
    for a, b in sizes * 5:
        sketch = rnd.bytes(2 * size)
        rows += [(len(rows), a, sketch), (len(rows) + 1, b, sketch)]
    sketches = spark.createDataFrame(rows, "id bigint, n_shingles bigint, sketch binary")
    buckets = sketches.selectExpr("1L AS key", "0L AS leader", "id AS member")
    found = neardup.second_look(buckets, spark.createDataFrame([], "id bigint, component bigint"), sketches, size, 15, percent)
    groups: dict = {}
    for r in found.collect():
        groups.setdefault(r["gid"], set()).add(r["member"])
    assert sorted(map(sorted, groups.values())) == [[k, k + 1] for k in range(1, len(rows), 2)]


def test_sketches_estimate_similarity():
    rnd = np.random.default_rng(1)
    common, a, b = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    s = neardup.fast_sketches([np.concatenate([common, a]), np.concatenate([common, b]), np.zeros(0, np.uint64), common[:1]], 200)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    assert (s[2] == neardup.EMPTY).all() and (s[3] != neardup.EMPTY).all()


@pytest.mark.parametrize("last", [1 << 16, 0])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(neardup, "LAST_LINKS", last)
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 21), (6, 5), (30, 30)]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert {k: min(x for x in got if got[x] == v) for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_components_of_long_chains(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LAST_LINKS", 0)
    made = []
    plain = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, label: made.append(label) or plain(df, label))
    chain = [(k, k + 1) for k in range(1000)] + [(5000 + (k * 7919) % 997, 5000 + ((k + 1) * 7919) % 997) for k in range(996)] + [(9999, k) for k in range(9000, 9300)]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert len(got) == 1001 + 997 + 301 and sorted(list(got.values()).count(c) for c in set(got.values())) == [301, 997, 1001]
    assert made.count("links") < 25


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_suffix_dedup(docs, rows, empty, block_bytes):
    found = suffix_dedup.remove_repeats(docs, block_bytes=block_bytes, bucket_entries=1000)
    got = sorted(tuple(r) for r in suffix_dedup.digest(found).collect())
    short = [(i, t if t is None or len(t) < 20000 else t) for i, t in rows]
    assert got == sorted(suffix_dedup.brute_force(short))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_ties_and_nulls(spark):
    same = "0123456789" * 8
    df = spark.createDataFrame([(1, same), (1, same), (2, "ab" + same[:55]), (None, same), (3, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect())
    assert got == [(0, 80), (1, 0), (1, 0), (2, 55), (3, 0)]


@pytest.mark.parametrize("length", [42, 50, 61])
def test_suffix_dedup_of_few_letters(spark, length):
    """Periodic texts, ties of every length, zero bytes, and passages met at other residues and at the edges of documents."""
    rnd = random.Random(length)
    passages = ["".join(rnd.choices("ab\0", k=rnd.randint(30, 150))) for _ in range(12)] + ["ab" * 60, "a" * 200, "\0" * 90]
    rows = []
    for k in range(60):
        parts = ["".join(rnd.choices("abc", k=rnd.randint(0, 25))) + rnd.choice(passages)[rnd.randint(0, 20) :] for _ in range(rnd.randint(0, 4))]
        rows.append((rnd.randint(0, 40), "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = suffix_dedup.remove_repeats(df, length=length, block_bytes=700, bucket_entries=64)
    assert sorted(tuple(r) for r in suffix_dedup.digest(found).collect()) == sorted(suffix_dedup.brute_force(rows, length))


def test_suffix_dedup_does_not_trust_hashes(spark):
    """Two different texts that polynomial hashes modulo a power of two take for equal."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = one.translate({97: 98, 98: 97})
    rows = [(1, "x" + one[:1024] + "y"), (2, "x" + other[:1024] + "y"), (3, other[1024:]), (4, "z" * 60 + one[1024:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()) == sorted(suffix_dedup.brute_force(rows))


def test_difference_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


PII = [
    "mail a.b+c@x-y.example.com, ip 1.2.3.4.5.6.7.8 and 300.1.1.1",
    "card 4012 8888 8888 1881 then 4012888888881882 and 1234-5678",
    "+1 (212) 555-0100 or +44 20 7946 0958 x, +12",
    'token = "ab12cd34ef56ab12cd34ef56" price $12345678 id 0123456789012345',
    "@@a@b a@b. a@b.c@d.e ++1 2",
    "9" * 4000 + "." + "@" * 500 + "+1 " + "(" * 3000,
]


def test_private_data(spark):
    rows = [(k, t) for k, t in enumerate([*PII, "", None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.private_data(df, redacted=True).withColumn("sum", F.sha2("base", 256)).collect()}
    for k, t in rows:
        assert got[k]["sum"] == pii.brute_force(t), t
        assert set(filter(None, got[k]["base"].split(","))) <= set(filter(None, got[k]["spans"].split(",")))
    assert "example.com" not in got[0]["redacted"] and "[email]" in got[0]["redacted"] and got[7]["redacted"] is None
    assert "secret" in got[3]["spans"]
    assert pii.private_data(df.limit(0)).count() == 0


def test_private_data_of_long_texts():
    """Time in proportion to the spans of a text."""
    text = " ".join(f"{k:07d}9 'tok{k:016d}' a{k}@b" for k in range(40000))
    start = time.time()
    base, more = pii.candidates(text)
    assert len(base) + len(more) > 110000 and time.time() - start < 10
    taken = sorted((a, b) for a, _, b in more)
    assert all(b <= c for (_, b), (c, _) in zip(taken, taken[1:]))


def test_private_data_spans_by_hand(spark):
    """The spans that the method adds: each candidate that the trained model accepts, and nothing else."""
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate([*PII, PII[3], None, ""])] + [(None, PII[0], "s")], "doc_id bigint, text string, spans string")
    model = pii.fit(df)
    for r in pii.private_data(df, model).collect():
        text = PII[0] if r["doc_id"] is None else [*PII, PII[3], None, ""][r["doc_id"]]
        base, more = pii.candidates(text or "")
        want = sorted([*base, *(x for x in more if model.accepts(pii.features(text, *x)))])
        assert r["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)


def test_em_finds_the_unreliable_labeler():
    rnd = np.random.default_rng(2)
    truth = rnd.integers(0, 2, 4000)
    right = np.array([0.95, 0.9, 0.85, 0.55])
    v = np.where(rnd.random((4000, 4)) < right, 2 * truth[:, None] - 1, 1 - 2 * truth[:, None])
    tables, post = pii.reliabilities(v, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > 0.93
    assert tables[0, 1, 2] > tables[3, 1, 2]


def test_quality_learns(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        w = rnd.choices(WORDS, k=60)
        rows.append((k, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((k, int(good)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "the of")], "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.quality(docs, marks).collect()}
    held = [(got[k]["predicted"], want) for k, want in labels if got[k]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] <= 1 and got[None]["held_out"] is False
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in labels)
    assert quality.quality(docs.limit(0), marks.limit(0)).count() == 0
    assert {r["score"] for r in quality.quality(docs.limit(3), marks.limit(0)).collect()} == {0.5}


def test_quality_of_conflicting_labels_and_repeats(spark):
    """An id with several labels counts by the least; results do not depend on partitions; clashing columns stay out of the way."""
    rnd = random.Random(9)
    rows = [(k // 2, " ".join(rnd.choices(WORDS, k=20)) if k % 3 else None, 0.5, k) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, label bigint")
    marks = [(k, k % 2) for k in range(60)]
    twice = spark.createDataFrame([*marks, *((k, 1) for k in range(60))], "doc_id bigint, quality int")
    want = quality.fit(docs, spark.createDataFrame(marks, "doc_id bigint, quality int"))
    for parts in (1, 5):
        got = quality.fit(docs.repartition(parts), twice.repartition(parts))
        assert np.array_equal(got.weights, want.weights) and got.bias == want.bias
    assert quality.quality(docs, twice).count() == 120
    few = quality.fit(docs, twice, most_ngrams=100)
    assert not np.array_equal(few.weights, want.weights)


def test_scores_are_sparse_dot_products(spark, docs, rows):
    """Scores against plain sums of weights, text by text, wherever a text stands and whatever is scored with it."""
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.drop("score"), model, ["doc_id"]).collect()}
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        codes, _ = quality.ngrams(raw, np.array([0, len(raw)]), 0, 1, model.bits)
        total = 0.0
        for c in codes.tolist():
            total += float(model.weights[c])
        margin = model.bias + quality.SCALE * total / max(1, len(codes))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)
    assert len({round(v, 6) for v in got.values()}) > 10


def test_quality_learns_from_whole_counts(spark):
    text = "word " * 70000 + "other thing " * 40000
    raw = np.frombuffer(text.encode(), np.uint8)
    codes, _ = quality.ngrams(raw, np.array([0, len(raw)]), 0, 1, quality.BITS)
    terms, counts = np.unique(codes, return_counts=True)
    assert counts.max() > 65535
    want = quality.train([(1, terms, counts.astype(np.float64))])
    got = quality.fit(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert np.array_equal(got.weights, want.weights) and got.bias == want.bias


def test_audio(docs, rows, empty):
    got = {r["doc_id"]: r for r in audio.media_features(docs).collect()}
    seen = {}
    for i, t in rows:
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["tail_crc32"], got[i]["media_bytes"]) == (len(raw), len(want), zlib.crc32(want[-32:]), len(want) + 44)
        assert seen.setdefault(raw, got[i]["feature"]) == got[i]["feature"]
    assert audio.media_features(empty).count() == 0
    assert audio.read_wav(audio.wav(b"abc")) == (b"abc", audio.STORED_RATE)


def samples(x):
    return np.round(x * 120 + 128).astype(np.uint8)


def test_resampling_keeps_a_tone():
    t = np.arange(24000) / 24000
    tone = samples(np.sin(2 * np.pi * 1000 * t))
    out = audio.resample(tone)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(out)) / 16000) * 120 / 128
    assert len(out) == 16000 and np.abs(out[100:-100] - want[100:-100]).max() < 0.02
    mels, _ = audio.log_mel(tone)
    low, _ = audio.log_mel(samples(np.sin(2 * np.pi * 200 * t)))
    assert mels.mean(axis=0).argmax() > low.mean(axis=0).argmax()


@pytest.mark.parametrize("n", [1, 576, 576 * 3, 24000 * 9 + 7])
def test_audio_in_pieces(n, monkeypatch):
    """Pieces give what the whole gives: resampling by its definition, and features whatever the piece."""
    x = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    whole = audio.resample(x)
    assert np.array_equal(np.concatenate([audio.resample(x, a, min(len(whole), a + 1001)) for a in range(0, len(whole), 1001)]).round(4), whole.round(4))
    h = audio.phases().T.ravel()
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = (x.astype(float) - 128) / 128
    half = audio.TAPS * max(audio.UP, audio.DOWN) // 2
    want = np.convolve(up, h)[half :: audio.DOWN][: len(whole)]
    assert np.abs(want - whole[: len(want)]).max() < 1e-4
    mels, energy = audio.log_mel(x)
    monkeypatch.setattr(audio, "FRAMES_AT_ONCE", 7)
    other, other_energy = audio.log_mel(x)
    assert np.allclose(mels.astype(float), other.astype(float), atol=0.02) and np.allclose(energy, other_energy, atol=1e-3)


def test_hysteresis():
    e = np.array([0, 0, 0, -10, -3, -3, 0, -3, -10, -3, -10], np.float32)
    assert audio.segments(e, high=1.0, low=-2.0) == [(0, 3), (4, 8)]
    assert audio.segments(np.zeros(5, np.float32)) == [(0, 5)]


def test_clips_are_arrow_tensors_with_spans(docs):
    media = audio.encode_audio(docs, ["doc_id"])
    table = audio.features(media, ["doc_id"]).select("doc_id", "clips", "n_frames").toArrow()
    clips = audio.read_clips(table["clips"].combine_chunks())
    assert clips.schema == audio.CLIPS and clips["log_mel"].combine_chunks().to_numpy_ndarray().shape[1:] == (audio.CLIP, audio.BANDS)
    assert clips.num_rows == sum(-(-n // audio.CLIP) for n in table["n_frames"].to_pylist())
    one = audio.read_clips(table["clips"].combine_chunks()[:1])
    assert one["start_ms"].to_pylist() == [960.0 * k for k in range(one.num_rows)] and one["end_ms"][-1].as_py() == 10.0 * (table["n_frames"][0].as_py() - 1) + 25
    assert audio.read_clips(pa.array([None], pa.binary())).num_rows == 0


def test_audio_values(spark):
    """Every column of the query against the definitions, for repeated rows, null keys, clashing names and a long text."""
    long = "long text " * 40000
    rows = [(1, "abc", "x"), (1, "abc", "y"), (None, "abc", None), (2, None, None), (3, "", "z"), (4, long, "w")]
    got = audio.media_features(spark.createDataFrame(rows, "doc_id bigint, text string, media string").repartition(2)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 1, 2, 3, 4]
    for r in got:
        raw = next((t or "") for d, t, _ in rows if d == r["doc_id"]).encode()
        data = audio.payload(raw)
        media = audio.wav(data)
        mels, energy = audio.log_mel(np.frombuffer(data, np.uint8))
        spans = ",".join(f"{int(a * 10.0)}-{int((b - 1) * 10.0 + 25.0)}" for a, b in audio.segments(energy))
        want = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(mels)};{hashlib.sha256(audio.write_clips(mels)).hexdigest()};{spans}")
        assert tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == want
        assert audio.read_wav(media)[0][: len(raw)] == raw


LONG = "The quick story of the town and the people that live in it is told here with all the care of a writer who has the time for it. " * 2

PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site name</h1><p>{LONG}</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">{LONG}</div>
<article><h1>Head &amp; line</h1><p class=lead>{LONG}<br>more&nbsp;text<p>Short end.</p><div class="ad-box">{LONG}</div><aside>{LONG}</aside><ul><li>One point<li>Two</ul><form><label>{LONG}</label></form></article>
<section id="comments"><p>{LONG}</p></section><footer>&copy; {LONG}</footer></body></html>"""


def test_main_text():
    got = html_text.main_text(PAGE)
    body = " ".join(LONG.split())
    assert got == f"Head & line\n{body} more text\nShort end.\nOne point\nTwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("<p>plain") == "plain"
    assert html_text.main_text(f"<div><p>{LONG}</div><div><a href=x>{LONG}</a></div>") == body
    assert html_text.main_text("<p>5 < 6 & 7 &lt; 8") == "5 < 6 & 7 < 8"


def test_main_text_of_named_wrappers():
    body = " ".join(LONG.split())
    for names in ("page has-sidebar", "no-sidebar", "header-fixed"):
        for tag in ("article", "main"):
            assert html_text.main_text(f'<body><div class="{names}"><{tag}><p>{LONG}</p></{tag}><div>Other {LONG}</div></div></body>') == body
    assert html_text.main_text(f'<article><p>{LONG}</p></article><div class="sidebar"><article><p>Other {LONG}</p></article></div>') == body
    assert html_text.main_text(f'<div><p>{LONG}</p></div><div class="comments"><article><p>Other {LONG}</p></article></div>') == body


def test_main_text_without_known_words():
    russian = " ".join(["Город стоял над рекой, и люди жили здесь давно."] * 6)
    chinese = "这座城市坐落在河边，人们在这里生活了很久。" * 12
    for text in (russian, chinese):
        menu = f'<div><a href="/a">{text}</a></div>'
        assert html_text.main_text(f"{menu}<div><p>{text}</p><p>{text}</p></div>{menu}") == f"{text}\n{text}"
    code = "x = compute(y, z); " * 15
    assert html_text.main_text(f"<div><p>{LONG}</p><pre>{code}</pre><p>{LONG}</p></div>").split("\n")[1] == code.strip()


def test_main_text_drops_and_keeps_inside_an_article():
    body = " ".join(LONG.split())
    for name in ("banner", "ad", "cookie-notice", "copyright"):
        assert html_text.main_text(f"<article><h1>Head</h1><p>{LONG}</p><div class={name}>Buy now. {LONG}</div><p>{LONG}</p></article>") == f"Head\n{body}\n{body}"
    for name in ("teaser", "tags", "byline"):
        assert html_text.main_text(f"<article><div class={name}>By the author</div><p>{LONG}</p></article>") == f"By the author\n{body}"
    assert html_text.main_text(f"<article><div class=hero-banner><h1>Head</h1><p>Offer</p></div><p>{LONG}</p></article>") == f"Head\n{body}"
    assert html_text.main_text(f"<article><p>{LONG}</p><ul><li><a href=/x>One</a><li>Two <a href=/y>three</a></ul><p>End</article>") == f"{body}\nOne\nTwo three\nEnd"
    menu = "Summer Deals Winter Boots Garden Tools Kitchen Knives Running Shoes Desk Lamps"
    assert html_text.main_text(f"<article><p>{LONG}</p><h3>More stories</h3><p><a href=/z>{menu}</a></p></article>") == body


def test_main_text_of_unclosed_elements_and_forms():
    body = " ".join(LONG.split())
    for name in ("object", "svg", "math", "select", "iframe", "noscript", "canvas", "audio", "video", "template", "title", "textarea", "nav", "aside", "form", "div class=ad", "span hidden"):
        assert html_text.main_text(f"<article><p>{LONG}</p><{name}><p>{LONG}</p></article>") == f"{body}\n{body}", name
        close = name.split()[0]
        assert html_text.main_text(f"<article><p>{LONG}</p><{name}>gone</{close}><p>{LONG}</p></article>") == f"{body}\n{body}", name
    assert html_text.main_text(f"<form id=page><nav><a href=/>x</a></nav><article><p>{LONG}</p><form>{LONG}</form></article></form>") == body
    assert html_text.main_text(f"<article><p>{LONG}</p><script>var a = 1; <p>{LONG}</p></article>") == body
    assert html_text.main_text(f'<article><p title="a > b">{LONG}</p><p title=\'x>{LONG}</p></article>').startswith(body)
    assert html_text.main_text(f"<p class=notice>{LONG}<div><p>{LONG}</p></div>") == body


def test_second_pass_decides():
    """What the first pass leaves open goes with its neighbours, and the answer depends on it."""
    good = " ".join(LONG.split())
    bad = "Winter Boots Garden Tools Kitchen Knives Running Shoes Desk Lamps " * 4
    page = f"<div><h2>Story</h2><p>{LONG}</p><p>It ends here.</p></div><div><h2>Offers</h2><p>{bad}</p><p>Only today.</p></div>"
    found = html_text.blocks(page)
    first = [html_text.decide(b) for b in found]
    assert first == [None, True, None, None, False, None]
    assert html_text.inherit(first, [b.heading for b in found]) == [True, True, True, False, False, False]
    assert html_text.main_text(page) == f"Story\n{good}\nIt ends here."
    assert html_text.inherit([None, None], [False, True]) == [True, True] and html_text.inherit([None, False], [True, False]) == [True, False]
    assert html_text.inherit([True, None, False], [False, False, False]) == [True, True, False]


def test_main_text_takes_linear_time():
    for page in ("<p>short words here</p>" * 100000, "<div>" * 40000 + "</section>" * 40000, "<li><a href=x>y</a>" * 100000, "<object>" * 100000, "<p><b>x" * 100000):
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 5  # a second on a free core
    assert html_text.main_text("<p>short words here</p>" * 1000).count("\n") == 999


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id bigint, url string, html string, text string")
    got = html_text.extract(df, ["page_id", "url"]).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0), ["page_id"]).count() == 0


@pytest.mark.parametrize("name", ["op7_positional_index", "op8_cover_suffix_dedup", "op10_fast_sketch_dedup"])
def test_queries_match_sql(spark, small, name):
    import duckdb

    from webloom.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    found = QUERIES[name](spark, small)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_recall_of_near_duplicates(spark):
    """Against brute force on the thousand documents of the small tables: no link is lost."""
    data = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for width, percent in ((3, 85), (5, 80)):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width, percent).collect())
        assert got == sorted(neardup.brute_force(rows, width, percent))


def test_contamination_with_many_pieces(spark, small):
    """Many items in many pieces give what one piece gives."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    more = items.selectExpr("cast(item_id AS string) item_id", "text").union(docs.filter("doc_id % 3 = 0").selectExpr("concat('d', doc_id)", "text"))
    one, many = (sorted(tuple(r) for r in contamination.digest(contamination.contamination(docs, more, query_bytes=n)).collect()) for n in (1 << 24, 40000))
    assert one == many and any(r[5] for r in one)


def test_discarded_tables_are_gone(spark, tmp_path):
    from pathlib import Path

    from webloom import storage

    df = storage.materialize(spark.range(5), "x")
    path = Path(df.stored_at.removeprefix("file://"))
    assert path.is_dir() and df.count() == 5
    before = spark.conf.getAll
    storage.discard(df, None, spark.range(1))
    assert not path.exists() and spark.conf.getAll == before


def test_contamination_of_repeated_rows_and_null_keys(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (None, text), (2, None), (None, "w1 w2"), (3, "x " * 40 + text), (4, text.upper())]
    items = [("b", text), ("b", text), ("a", " ".join(text.split()[5:20])), (None, "w1 w2 w9"), ("c", "w1 w2")]
    docs = spark.createDataFrame([(*r, "i", 9) for r in rows], "doc_id bigint, text string, items string, n_words int").repartition(3)
    bench = spark.createDataFrame([(*i, "t") for i in items], "item_id string, text string, doc_id string")
    got = contamination.digest(contamination.contamination(docs, bench)).collect()
    want = contamination.brute_force(rows, [(i or "", t) for i, t in items])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_near_duplicates_of_many_revisions(spark):
    """A document and its successive revisions: each like the one before, the last unlike the first, all one class."""
    words = [f"w{k}" for k in range(300)]
    rows = [(100, " ".join(words))]
    for k in range(60):
        words[(k * 37) % 300 : (k * 37) % 300 + 4] = [f"r{k}x{j}" for j in range(4)]
        rows.append((99 - k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, 3, 85).collect())
    assert got == sorted(neardup.brute_force(rows, 3, 85)) and {r[2] for r in got} == {40}


def test_private_data_and_main_text_of_very_long_texts(spark):
    text = "plain words and more of them " * 60000 + "mail a.b@c.example.com end"
    docs = spark.createDataFrame([(1, text), (2, "9" * 300000), (3, "@" * 300000), (4, "+1 " * 100000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.private_data(docs).withColumn("sum", F.sha2("base", 256)).collect()}
    assert got[1]["n_email"] == 1 and all(got[k]["sum"] == pii.brute_force(t) for k, t in ((1, text), (4, "+1 " * 100000)))
    page = f"<article><p>{text}</p></article>"
    assert html_text.main_text(page) == " ".join(text.split())

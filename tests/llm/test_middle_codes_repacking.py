"""Fill-in-the-middle, vector codes and certified packing against brute force."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webloom.llm import fill_middle, repacking, vector_codes
from webloom.llm.queries import ORACLE_SQL, QUERIES, WORDS
from webloom.llm.tokens import WordEncoder

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+\s*|\s+", "char": r"(?s)."}


def middle(key, text, unit="line", seed=7, rate=100, spm=50):
    """The transformation in plain steps."""
    x = text or ""
    units = re.findall(PATTERNS[unit], x)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not x or any(z in x for z in fill_middle.SENTINELS) or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"
    out = {"plain": x, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (key, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out, x)


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "with <M> inside\nx", "tail <P", "é\nß\n漢字\n🙂 x\n", "x" * 3000, "line\n" * 700, "x\n" * 299 + "<S>", "a" * 127 + "<P>" + "b" * 200, "a" * 126 + "\n" + "b\n" * 80,
    "é" * 500 + "\n" + "漢\n" * 400, "\r\n\t \n" * 50, "same\ntext\n", "same\ntext\n",
]


def test_middle_equals_plain_steps_whatever_the_chunks(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "a\nb\n", "n"), (0, "again\nx\ny\n", "id twice"), (4, "one line", "row twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    for size in (1 << 16, 128, 5):
        found = fill_middle.fill_in_middle(docs, chunk_bytes=size).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
        got = sorted(map(tuple, found.collect()), key=str)
        assert got == sorted((middle(k, t) for k, t, _ in rows), key=str), size


@pytest.mark.parametrize("unit", ["word", "char"])
def test_middle_by_other_units(spark, unit):
    rows = [(str(k), t) for k, t in enumerate(["", "a b  c", "one two\tthree ", "é漢 🙂 x y" * 40, "word " * 90]) ]
    docs = spark.createDataFrame(rows, "name string, body string")
    for size in (1 << 16, 64):
        found = fill_middle.fill_in_middle(docs, unit=unit, seed=3, rate=70, spm=20, key="name", text="body", chunk_bytes=size)
        got = sorted((r["name"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found.collect())
        assert got == sorted(middle(k, t, unit, 3, 70, 20)[:6] for k, t in rows), (unit, size)


def test_middle_of_no_documents(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_chunked_fim", "op12_annular_codes"])
def test_queries_equal_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df().astype(str)
    found = QUERIES[name](spark, small).toPandas()[list(want.columns)].astype(str)
    key = list(want.columns)
    assert found.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_middle_restores_every_text(spark, small):
    found = QUERIES["op11_chunked_fim"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id")
    assert found.filter(F.col("restored_sha256") != F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).count() == 0
    assert {r["form"] for r in found.select("form").distinct().collect()} >= {"psm", "spm"}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 4), st.integers(0, 3), st.randoms(use_true_random=False))
def test_annulus_finds_the_nearest_entry(entries, width, spread, random):
    top = 4**spread
    book = np.array([[random.randint(-top, top) for _ in range(width)] for _ in range(entries)])
    points = np.array([[random.randint(-2 * top, 2 * top) for _ in range(width)] for _ in range(50)])
    index, distance = vector_codes.nearest(points, book)
    every = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert index.tolist() == every.argmin(axis=1).tolist()
    assert distance.tolist() == every.min(axis=1).tolist()


def test_annulus_leaves_out_far_entries():
    norms = np.array([1.0, 5.0, 9.0, 100.0])
    low, high = vector_codes.annulus(norms, np.array([7.0]), np.array([4]))
    assert (low[0], high[0]) == (1, 3)


def plain_codes(frame, parts=8, entries=16, rounds=6, scale=4096):
    ok = [v is not None and all(c is not None and np.isfinite(c) for c in v) for v in frame["embedding"]]
    frame = frame[ok].copy()
    order = sorted(range(len(frame)), key=lambda k: frame["vec_id"].iloc[k])
    x = np.floor(np.array(frame["embedding"].tolist(), float) * scale).astype(np.int64)
    width, codes, error, books = x.shape[1] // parts, [], 0, []
    for p in range(parts):
        y = x[:, p * width : (p + 1) * width]
        book = y[order[:entries]].copy()
        for r in range(rounds + 1):
            every = ((y[:, None, :] - book[None]) ** 2).sum(axis=2)
            near = every.argmin(axis=1)
            if r < rounds:
                book = np.array([y[near == e].sum(axis=0) // (near == e).sum() if (near == e).any() else book[e] for e in range(len(book))])
        codes.append(near)
        error = error + every.min(axis=1)
        books.append(book)
    frame["code"] = ["".join(f"{c:02x}" for c in row) for row in np.array(codes).T]
    frame["error"] = error
    frame["label_error"] = frame.groupby("label", dropna=False)["error"].transform("sum")
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, c, e, l, digest) for i, c, e, l in zip(frame["vec_id"], frame["code"], frame["error"], frame["label_error"], strict=True))


@pytest.mark.parametrize("n", [3, 16, 400])
def test_codes_equal_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k), [float(v) for v in np.round(rng.normal(size=16), 2)], int(k % 3) if k % 5 else None) for k in rng.permutation(n)]
    rows += [(n + 1, None, 1), (-1, [float("nan")] + [0.0] * 15, 1), (-2, [None] + [0.0] * 15, 1), (-3, [float("inf")] + [0.0] * 15, 2)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("code", F.lit("clash"))
    found = vector_codes.compress(vectors).collect()
    assert sorted(map(tuple, found)) == plain_codes(pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]))


def test_codes_of_odd_tables(spark, monkeypatch):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    rows = [(1, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [2.0] * 9, 1), (3, [], None), (None, [3.0] * 8, None)]
    found = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(spark.createDataFrame(rows, kind)).collect()}
    assert found == {(1, "00" * 8, 0, 0), (2, None, None, 0), (3, None, None, 0), (None, "02" * 8, 0, 0)}
    many = spark.createDataFrame([(k, [float(k % 7)] * 7 + [float(k)], k % 4) for k in range(200)], kind)
    want = sorted(map(tuple, vector_codes.compress(many).collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert sorted(map(tuple, vector_codes.compress(many).collect())) == want


def fewest(sizes, capacity):
    """Windows of an optimal packing, by search over all assignments up to symmetry."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= sizes[k]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
def test_bound_never_exceeds_an_optimal_packing(case):
    capacity, sizes = case
    sizes.sort(reverse=True)
    counts = repacking.histogram(np.array(sizes, np.int64), capacity)
    assert repacking.lower_bound(counts, capacity) <= fewest(sizes, capacity)


@pytest.mark.parametrize(("capacity", "sizes", "bound"), [(10, [6] * 5, 5), (10, [5] * 5, 3), (12, [4] * 7, 3), (10, [4, 4, 4], 2), (30, [16, 11, 11, 11], 2), (10, [], 0)])
def test_bound_beyond_the_sum_of_sizes(capacity, sizes, bound):
    assert repacking.lower_bound(repacking.histogram(np.array(sizes, np.int64), capacity), capacity) == bound


def check_packing(found, capacity, docs, tokenizer, end_id=1):
    """Every id of every document lies in one piece, cut only at the capacity; sequences have no gaps and fit."""
    tok = Tokenizer.from_file(tokenizer)
    want = sorted((doc, tuple(tok.encode(text or "", add_special_tokens=False).ids) + (end_id,)) for doc, text in docs)
    pieces = [r.asDict() | {"ids": np.frombuffer(r["ids"], "<u2").tolist()} for r in found.collect()]
    assert all(len(p["ids"]) == p["length"] and p["start"] == p["piece"] * capacity for p in pieces)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["piece"])):
        by_doc.setdefault((p["doc_id"]), []).extend(p["ids"])
    assert sorted((d, tuple(ids)) for d, ids in by_doc.items()) == want
    for _, group in itertools.groupby(sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])), key=lambda p: p["sequence_id"]):
        at = 0
        for p in group:
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len({p["sequence_id"] for p in pieces}), sum(p["length"] for p in pieces)


def test_certified_packing_over_many_partitions(spark):
    path = public_tokenizers.path(WORDS)
    rng = np.random.default_rng(5)
    words = ["tree", "river", "stone", "naïve", "don't", "x1y", "...", "Über"]
    docs = [(k, " ".join(rng.choice(words, int(n)))) for k, n in enumerate(rng.integers(0, 60, 300))] + [(900, None), (901, ""), (902, "long " * 700)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(11)
    found = repacking.pack_certified(frame, path, capacity=64, block_ids=200, limit=40, fan_in=2).cache()
    windows, total = check_packing(found, 64, docs, path)
    count, bound = repacking.certificate(found, 64)
    assert count == windows and bound <= windows <= 1.03 * bound + 1
    single = [found.filter("sequence_id >> 33 = 0")]
    assert single[0].count() > 0


def test_exchange_lowers_the_count(spark):
    """Two partitions of large pieces and two of small ones, each packed as well as it can be, are better together."""
    path = public_tokenizers.path(WORDS)
    docs = [(k, "tree " * (38 if k % 4 < 2 else 18)) for k in range(80)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartitionByRange(4, (F.col("doc_id") % 4))
    found = repacking.pack_certified(frame, path, capacity=60, limit=400)
    assert check_packing(found, 60, docs, path)[0] == 40
    assert repacking.certificate(found, 60) == (40, 40)


def test_certified_packing_of_odd_tables(spark):
    path = public_tokenizers.path(WORDS)
    assert repacking.pack_certified(spark.createDataFrame([], "doc_id bigint, text string"), path).count() == 0
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    found = repacking.pack_certified(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")), path)
    assert sorted((r["doc_id"] or 0, r["length"]) for r in found.collect()) == [(0, 3), (1, 3), (1, 3), (2, 1)]
    named = spark.createDataFrame([("x", "word")], "name string, body string")
    assert repacking.pack_certified(named, path, key="name", text="body").first()["name"] == "x"


def test_word_encoder_equals_tokenizers(small, spark):
    path = public_tokenizers.path(WORDS)
    encode, tok = WordEncoder(path), Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += ["", "don't we'll 'stop --'s ''s x's", "A1B2 3.14 ½ ²", "ΑΣ ΣΑΣ σς", "İstanbul ǅ ß ẞ", "naïve café́", "<|endoftext|> <|endoftext", "漢字 かな 한국어", "a" * 5000, "\x85​\x1c a", "…— ‘q’ “w”", "_under_score", "Ѐё Жя", "ŉ ſ ĳ", "🙂🙂 x", "a\x00b"]
    for t in texts:
        assert encode(t).tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]

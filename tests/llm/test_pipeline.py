"""The corpus pipeline: its stages keep what they should, and their decisions take effect."""

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from webloom.llm import contamination, neardup, pii, quality  # noqa: E402
from webloom.llm.common import table  # noqa: E402
from webloom.llm.queries import BPE  # noqa: E402
from webloom.llm.tokens import Encoder  # noqa: E402


def test_stages_one_by_one(spark, small):
    docs = table(spark, small, "documents").select(*pipeline.COLUMNS)
    stages = dict(pipeline.STAGES)
    assert len(stages) == 5
    good = stages["quality classifier"](spark, docs, small).cache()
    assert good.columns == pipeline.COLUMNS and 0 < good.count() <= docs.count()
    accepted = quality.quality(docs, table(spark, small, "labels")).filter("score >= 0.3").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in accepted)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    one = stages["near duplicates"](spark, good, small).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, _, _, kept in neardup.brute_force(rows, 5, 80) if kept)
    items = [(str(r["item_id"]), r["text"]) for r in table(spark, small, "benchmark").collect()]
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    clean = stages["benchmark decontamination"](spark, one, small).cache()
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r[0] for r in contamination.brute_force(rows, items) if not r[5])
    private = stages["personal data"](spark, clean, small).cache()
    assert private.columns == pipeline.COLUMNS and private.count() == clean.count()
    model = pii.fit(clean)
    want = {r["doc_id"]: pii.redact(r["text"], pii.find(r["text"], model)[1]) if r["text"] else r["text"] for r in clean.collect()}
    assert {r["doc_id"]: r["text"] for r in private.collect()} == want
    for r in private.collect():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
    pieces = stages["packing"](spark, private, small)
    found = pieces.collect()
    encode = Encoder(public_tokenizers.path(BPE))
    ids = {r["doc_id"]: [*encode(r["text"]).tolist(), 0] for r in private.collect()}
    assert {r["doc_id"]: r["doc_tokens"] for r in found} == {d: len(x) for d, x in ids.items()}
    for r in found:  # every piece has its document's ids, and pieces fill their sequences without gaps
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(own.tobytes())
    ends = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and sum(ends.values()) == sum(map(len, ids.values()))


def test_run(spark, small):
    assert pipeline.run(spark, small).count() > 0


def test_stages_decide_by_row_for_null_and_reused_ids(spark, small):
    items = [r["text"] for r in table(spark, small, "benchmark").collect() if len(r["text"].split()) > 30]
    other = ["".join(f"{w}{k} " for k in range(60)) for w in "abcde"]
    rows = [(None, items[0]), (7, items[1]), (7, other[0]), (8, other[1]), (None, other[2]), (9, other[2]), (8, other[3]), (None, other[4]), (None, other[4]), (10, ""), (10, ""), (11, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    stages = dict(pipeline.STAGES)

    def got(stage):
        return sorted(((r["doc_id"], r["text"]) for r in stages[stage](spark, docs, small).collect()), key=repr)

    bad = set(items[:2])
    assert got("benchmark decontamination") == sorted((r for r in rows if r[1] not in bad), key=repr)
    once = [(None, items[0]), (7, items[1]), (7, other[0]), (8, other[1]), (9, other[2]), (8, other[3]), (None, other[4]), (10, ""), (11, None)]
    assert got("near duplicates") == sorted(once, key=repr)

"""Ids that operators refuse, and sounds with their clips as stored tables."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import audio, contamination, neardup, packing, suffix_dedup

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(
    "operator",
    [lambda d: packing.pack_blocks(d, BPE), lambda d: packing.pack_online(d, BPE), contamination.build_index, suffix_dedup.remove_repeats, neardup.near_duplicates],
    ids=["pack_blocks", "pack_online", "build_index", "remove_repeats", "near_duplicates"],
)
def test_text_ids_are_refused(spark, operator):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    with pytest.raises(TypeError, match="integer ids"):
        operator(docs)


def test_stored_clips_are_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "words of a text " * 400), (2, None), (2, None)], "doc_id bigint, text string").withColumn("clips", F.lit("clash"))
    found = audio.store(docs, str(tmp_path / "audio"), ["doc_id"])
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    media = {r["doc_id"]: r["media"] for r in spark.read.parquet(str(tmp_path / "audio" / "media")).collect()}
    for r in rows:
        data, _ = audio.read_wav(media[r["doc_id"]])
        mels, _ = audio.log_mel(np.frombuffer(data, np.uint8))
        clips = audio.read_clips(pa.array([r["clips"]], pa.binary()))
        stored = clips["log_mel"].combine_chunks().to_numpy_ndarray() if hasattr(clips["log_mel"].combine_chunks(), "to_numpy_ndarray") else clips["log_mel"].chunk(0).to_numpy_ndarray()
        assert stored.shape[1:] == (audio.CLIP, audio.BANDS) and r["n_frames"] == len(mels)
        assert np.array_equal(stored.reshape(-1, audio.BANDS)[: len(mels)], mels.astype(np.float16))
        assert clips["start_ms"][0].as_py() == 0.0
    assert rows[1]["clips"] == rows[2]["clips"]


@pytest.mark.parametrize("most", [1, 30, 200, 10_000])
def test_segments_have_the_same_windows(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 12, 13, 14, 100):
        text = "--".join(rng.choice(["Word", "é", "x1", "long" * 9], n)) + "!"

        def windows(t):
            words = t.lower().replace("!", "").split("--") if t.strip("!") else []
            return {tuple(words[k : k + 13]) for k in range(max(1, len(words) - 12))} if words else set()

        parts = [p.decode() for p in contamination.segments(text.encode(), 13, most)]
        assert set().union(*map(windows, parts)) == windows(text)
        assert len(parts) == 1 or all(len(p.split("--")) >= 13 for p in parts)


def test_one_long_item_is_matched_in_pieces(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 3000)]
    docs = spark.createDataFrame([(k, " ".join(words[a : a + 40])) for k, a in enumerate(range(0, 2960, 37))] + [(900, "nothing of it")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("long", " ".join(words))], "item_id string, text string")
    one, many = (sorted(tuple(r) for r in contamination.digest(contamination.contamination(docs, bench, query_bytes=n)).collect()) for n in (1 << 24, 4000))
    assert one == many and sum(r[5] for r in one) == 80

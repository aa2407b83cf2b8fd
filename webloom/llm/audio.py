"""Audio features: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segments, as fixed-shape tensors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import releasing, text_slices

#: Payload unit and filler; sampling rates of the stored and the analysed sound; frame, hop, transform and bands; frames of a tensor.
UNIT, FILLER = 576, 255
STORED_RATE, UP, DOWN, TAPS = 24_000, 2, 3, 12
FRAME, HOP, FFT, BANDS, CLIP = 400, 160, 512, 40, 96
RATE = STORED_RATE * UP // DOWN
#: Frames whose samples are resampled and transformed at a time: beyond its samples, a sound costs what its features take.
FRAMES_AT_ONCE = 1024


def payload(text: bytes) -> bytes:
    """Text with filler up to a positive multiple of the unit."""
    return text + bytes([FILLER]) * (-len(text) % UNIT if text else UNIT)


def wav(samples: bytes, rate: int = STORED_RATE) -> bytes:
    """8-bit mono PCM in a RIFF container."""
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono PCM file; other forms raise."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def phases() -> np.ndarray:
    """Windowed-sinc low-pass, split into UP branches of equal length."""
    half = TAPS * max(UP, DOWN) // 2
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(UP, DOWN)) * np.kaiser(len(n), 8.0)
    h *= UP / h.sum()
    width = -(-len(h) // UP)
    return np.pad(h, (0, width * UP - len(h))).reshape(width, UP).T.astype(np.float32)


def resampled_length(n: int) -> int:
    return -(-n * UP // DOWN)


def resample(samples: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Change the rate of 8-bit samples by UP / DOWN: outputs ``first`` to ``last`` (default: all). Each output uses the one branch of
    the filter that meets non-zero inputs."""
    last = resampled_length(len(samples)) if last is None else last
    if last <= first:
        return np.zeros(0, np.float32)
    bank = phases()
    width = bank.shape[1]
    delay = (TAPS * max(UP, DOWN) // 2) // UP
    low, high = first * DOWN // UP + delay - width + 1, (last - 1) * DOWN // UP + delay + 1
    padded = np.zeros(high - low, np.float32)
    a, b = max(0, low), min(len(samples), high)
    if a < b:
        padded[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(last - first, np.float32)
    for k in range(first, min(first + UP, last)):
        at = np.arange(len(range(k, last, UP))) * DOWN + k * DOWN // UP + delay - width + 1 - low
        out[k - first :: UP] = view[at] @ bank[k * DOWN % UP][::-1]
    return out


@lru_cache(maxsize=1)
def mel_bank() -> tuple[np.ndarray, np.ndarray]:
    """Window, and triangular filters evenly spaced in mel, as (FFT // 2 + 1, BANDS)."""
    mel = np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), BANDS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    rise, fall = (f[:, None] - low) / (mid - low), (high - f[:, None]) / (high - mid)
    return np.hanning(FRAME + 1)[:-1].astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows of overlapping frames of resampled 8-bit samples (the last one filled with silence), and each frame's energy in dB."""
    window, bank = mel_bank()
    length = resampled_length(len(samples))
    n = 1 + -(-(length - FRAME) // HOP) if length > FRAME else 1
    mels, energy = np.empty((n, BANDS), np.float16), np.empty(n, np.float32)
    for a in range(0, n, FRAMES_AT_ONCE):
        b = min(n, a + FRAMES_AT_ONCE)
        x = np.zeros((b - a - 1) * HOP + FRAME, np.float32)
        part = resample(samples, a * HOP, min(length, a * HOP + len(x)))
        x[: len(part)] = part
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * window
        spectrum = np.fft.rfft(frames, FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[a:b] = np.log(power @ bank + np.float32(1e-6))
        energy[a:b] = 10 * np.log10((frames * frames).mean(axis=1) + np.float32(1e-9))
    return mels, energy


def segments(energy: np.ndarray, high: float = -1.0, low: float = -4.0) -> list[tuple[int, int]]:
    """Runs of frames (start, end) with energy over the median plus ``low`` dB that reach the median plus ``high`` dB somewhere."""
    middle = np.median(energy)
    over = np.concatenate([[False], energy >= middle + low, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1])
    reach = np.concatenate([[0], np.cumsum(energy >= middle + high)])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if reach[b] > reach[a]]


def encode_audio(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns``, and each whole text (a null is empty) as the samples of a WAV file in column media."""
    fields = ", ".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_slices(batch.column("_text"))
            step = 512
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                media = [wav(payload(raw[a:b].tobytes())) for a, b in zip(offsets[i : i + len(part)], offsets[i + 1 : i + 1 + len(part)], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(media, pa.binary())], names=[*columns, "media"])

    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(releasing(run), f"{fields}, media binary")


#: A sound's clips: log-mel frames as tensors of one shape, and the time that each clip spans.
CLIPS = pa.schema([("log_mel", pa.fixed_shape_tensor(pa.float16(), (CLIP, BANDS))), ("start_ms", pa.float64()), ("end_ms", pa.float64())])


def write_clips(mels: np.ndarray) -> bytes:
    """Frames as an Arrow stream of CLIPS; the last clip is filled with zeros, its span ends with its last frame."""
    n = -(-len(mels) // CLIP)
    clips = np.zeros((n, CLIP, BANDS), np.float16)
    clips.reshape(-1, BANDS)[: len(mels)] = mels
    first = np.arange(n) * CLIP
    last = np.minimum(first + CLIP, len(mels)) - 1
    step = 1000 * HOP / RATE
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(clips), pa.array(first * step), pa.array(last * step + 1000 * FRAME / RATE)], schema=CLIPS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CLIPS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_clips(column: pa.Array) -> pa.Table:
    """Clips of a column of stored streams as one table of CLIPS, in row order; nulls have none."""
    return pa.concat_tables([CLIPS.empty_table(), *(pa.ipc.open_stream(v.as_buffer()).read_all() for v in column if v.is_valid)])


def features(media: DataFrame, columns: list[str], column: str = "media") -> DataFrame:
    """Read sounds back and describe them: per row ``columns``, payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes), media_bytes,
    media_sha256, n_frames, clips (an Arrow stream of fixed-shape float16 tensors (CLIP, BANDS) and their time spans) and spans (array of
    segments in milliseconds). A null sound gives nulls; equal sounds give equal values; repeated rows and null columns are passed on."""
    fields = ", ".join(f"`{media.schema[c].name}` {media.schema[c].dataType.simpleString()}" for c in columns)
    schema = f"{fields}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_frames int, clips binary, spans array<struct<start_ms:double,end_ms:double>>"
    span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), span]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "clips", "spans"]

    def describe(sound: bytes | None) -> tuple:
        if sound is None:
            return (None,) * len(names)
        data, _ = read_wav(sound)
        mels, energy = log_mel(np.frombuffer(data, np.uint8))
        step = 1000 * HOP / RATE
        found = [{"start_ms": a * step, "end_ms": (b - 1) * step + 1000 * FRAME / RATE} for a, b in segments(energy)]
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(sound), hashlib.sha256(sound).hexdigest(), len(mels), write_clips(mels), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = list(zip(*(describe(s.as_py()) for s in part.column("_media")), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))], names=[*columns, *names])

    return media.select(*columns, F.col(column).alias("_media")).mapInArrow(releasing(run), schema)


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of encode_audio and features for every document: doc_id, n_bytes, payload and media sizes and sums, and the features as one
    string (frames, sum of the stored tensors, segments). Nulls and empty texts are one unit of filler; repeated rows give
    repeated results; keys are passed on as they are; an empty table gives no rows; other columns are not read."""
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text).alias("text"))
    found = features(encode_audio(own, ["doc_id", "n_bytes"]), ["doc_id", "n_bytes"])
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat(s["start_ms"].cast("int").cast("string"), F.lit("-"), s["end_ms"].cast("int").cast("string"))))
    feature = F.concat_ws(";", F.col("n_frames").cast("string"), F.sha2("clips", 256), spans)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "n_frames", F.size("spans").alias("n_spans"))


def store(docs: DataFrame, path: str, columns: list[str], text: str = "text") -> DataFrame:
    """Keep every text's sound and what was computed from it: tables ``media`` and ``features`` below ``path`` (which must be new), the features from the sounds read back. Returns the features as
    stored: ``columns``, the columns of ``features``, with clips as Arrow streams for ``read_clips``. Nulls, repeated rows and empty tables are as there."""
    spark = docs.sparkSession
    sounds = encode_audio(docs, columns, text)
    sounds.write.parquet(f"{path}/media")
    found = features(spark.read.schema(sounds.schema).parquet(f"{path}/media"), columns)
    found.write.parquet(f"{path}/features")
    return spark.read.schema(found.schema).parquet(f"{path}/features")

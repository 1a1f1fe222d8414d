"""Media columns: texts as 8-bit WAV, and spectral-peak pair fingerprints of the samples."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, text_columns

BLOCK = 576          # a payload is padded to a multiple of it
RATE = 8000
WINDOW, HOP = 512, 288
LEAST_FRAMES = 16    # payloads of fewer hops have a shorter one, so that short ones yield pairs too
BANDS = (1, 8, 16, 32, 64, 128, 257)  # spectrum bins; one peak a band and neighbourhood
REACH = 4            # frames on either side that a peak must exceed
FAN, SPAN = 3, 63    # pairs a peak begins, and frames between the two peaks of a pair
FRAMES_AT_ONCE = 2048

FEATURES = ("doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, "
            "tail_crc32 long, media_bytes long, media_sha256 string, "
            "fp_time array<int>, fp_pair array<int>")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono, one unsigned byte a sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def _band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its power for each frame (rows) and band (columns).

    Frames begin and end in silence beyond the samples, so each sample is inside a window. Half a
    window on either side mirrors the samples: a step there would drown the first and last.
    """
    hop = max(1, min(HOP, len(samples) // LEAST_FRAMES))
    half = WINDOW // 2
    mirrored = np.pad(samples, half, mode="symmetric")
    padded = np.pad(mirrored, (half, half + -len(samples) % hop), constant_values=128)
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::hop]
    hann = np.hanning(WINDOW + 1)[:-1].astype(np.float32)
    bins, powers = [], []
    for at in range(0, len(frames), FRAMES_AT_ONCE):  # bounds memory for long recordings
        block = (frames[at:at + FRAMES_AT_ONCE].astype(np.float32) - 128) * hann
        spectrum = np.fft.rfft(block, axis=1)
        power = spectrum.real ** 2 + spectrum.imag ** 2
        best = np.stack([power[:, a:b].argmax(1) + a for a, b in zip(BANDS, BANDS[1:])], 1)
        bins.append(best)
        powers.append(np.take_along_axis(power, best, 1))
    return np.concatenate(bins), np.concatenate(powers)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes (frames) and pair codes (bin, bin, frames between) of ``samples``.

    A peak is a band's strongest bin in a frame that exceeds the frames before it within reach
    and is not below those after. Each peak is paired with the next ``FAN`` later peaks.
    Silence has no peaks. Below ``LEAST_FRAMES * HOP`` samples the hop is a sixteenth of them.
    """
    bins, power = _band_peaks(samples)
    n = len(power)
    pad = np.full((REACH, power.shape[1]), -1, power.dtype)
    padded = np.concatenate([pad, power, pad])
    peak = power > 1e-3
    for k in range(1, REACH + 1):
        peak &= power > padded[REACH - k:REACH - k + n]
        peak &= power >= padded[REACH + k:REACH + k + n]
    at, band = np.nonzero(peak)
    freq = bins[at, band]
    times, pairs = [], []
    # The first peak of a later frame, then its neighbours in time and band order.
    later = np.searchsorted(at, at, side="right")
    for k in range(FAN):
        other = later + k
        ok = other < len(at)
        ok[ok] &= at[other[ok]] - at[ok] <= SPAN
        times.append(at[ok])
        pairs.append(freq[ok] << 15 | freq[other[ok]] << 6 | (at[other[ok]] - at[ok]))
    time, pair = np.concatenate(times), np.concatenate(pairs)
    order = np.lexsort((pair, time))
    return time[order].astype(np.int32), pair[order].astype(np.int32)


def media_table(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id`` (as text), ``n_bytes`` and the ``media`` column: the text's bytes as WAV.

    A NULL text is empty; every payload gets bytes 255 up to a positive multiple of ``block``.
    """
    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_bytes": [len(b) for b in raw],
                "media": [to_wav(b.ljust(max(block, -(-len(b) // block) * block), b"\xff"))
                          for b in raw]})

    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return keyed.mapInPandas(store, "doc_id string, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and fingerprints of the samples of a stored ``media`` column."""
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for pdf in batches:
            rows = []
            for doc_id, n, data in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"]):
                data = bytes(data)
                payload = from_wav(data)
                time, pair = fingerprint(np.frombuffer(payload, np.uint8))
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(),
                             zlib.crc32(payload[-32:]), len(data),
                             hashlib.sha256(data).hexdigest(), time, pair))
            yield pd.DataFrame(rows, columns=names)

    return media.mapInPandas(compute, FEATURES)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as stored WAV, read back, with its fingerprint as ``time:pair`` codes.

    Rows with NULL ids, repeated rows and empty texts are stored like any others; an empty
    table gives no rows. Columns other than doc_id and text take no part.
    """
    docs = text_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    path = scratch_path(spark, "media")
    media_table(docs).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    codes = F.zip_with("fp_time", "fp_pair", lambda t, p: F.concat(
        t.cast("string"), F.lit(":"), F.lower(F.hex(p))))
    return media_features(stored).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "payload_bytes",
        "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.array_join(codes, ",").alias("feature"))

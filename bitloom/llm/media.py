"""Media columns: payloads stored as WAV, and landmark fingerprints of their spectra.

A payload is stored losslessly as 8-bit mono samples by the wave module and read back by it. Short-time Fourier
transforms (Hann windows of FRAME samples, every HOP) give each frame's strongest bin in each of BANDS bands; bins that
stand out from the frame's mean are peaks. Pairs of peaks in neighbouring bands within REACH frames are landmarks,
kept as time-coded integers: frame << 32 | band-wise pair code.

Defined results: a null or empty text is one block of padding; payloads of any length are transformed whole, in blocks
of frames; equal texts give equal values, repeated rows repeated results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from bitloom.llm.common import per_row, text_bytes

#: Payloads are padded with bytes 255 to a positive multiple of this many bytes.
BLOCK = 576
RATE = 8000
FRAME, HOP = 576, 288
#: Edges of the bands in bins; bin 0 is the mean level.
BANDS = (1, 8, 20, 44, 92, 164, 289)
#: How often a peak exceeds its frame's mean, and how many frames apart peaks are paired.
STANDS_OUT, REACH = 2.0, 3
_FRAMES_AT_ONCE = 2048


def pad(raw: bytes) -> bytes:
    """The payload of a text: padded to a positive multiple of BLOCK."""
    return raw + b"\xff" * ((-len(raw)) % BLOCK if raw else BLOCK)


def to_wav(payload: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The peak bin of each frame and band, -1 where nothing stands out."""
    count = max(1, 1 + (len(samples) - FRAME) // HOP)
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((count, len(BANDS) - 1), dtype=np.int16)
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, count, _FRAMES_AT_ONCE):
        part = views[at : at + _FRAMES_AT_ONCE].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        size = np.abs(np.fft.rfft(part * window, axis=1))
        level = STANDS_OUT * size.mean(axis=1)
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            best = size[:, low:high].argmax(axis=1)
            strong = size[np.arange(len(size)), low + best] > level
            out[at : at + len(part), k] = np.where(strong, low + best, -1)
    return out


def landmarks(found: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks, sorted."""
    n, bands = found.shape
    out = []
    wide = found.astype(np.int64)
    for ahead in range(1, REACH + 1):
        if n <= ahead:
            break
        first, second = wide[:-ahead], wide[ahead:]
        times = np.arange(n - ahead, dtype=np.int64)
        for k in range(bands):
            for other in range(max(0, k - 1), min(bands, k + 2)):
                both = (first[:, k] >= 0) & (second[:, other] >= 0)
                out.append((times[both] << 32) | (first[both, k] << 16) | (second[both, other] << 4) | ahead)
    return np.sort(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)


def fingerprint(payload: bytes) -> tuple[int, np.ndarray]:
    """Number of peaks, and the landmarks."""
    found = peaks(np.frombuffer(payload, dtype=np.uint8))
    return int((found >= 0).sum()), landmarks(found)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the WAV file of each text's payload."""

    def rows(source):
        for doc_id, raw in source:
            yield doc_id, len(raw), to_wav(pad(raw))

    return per_row(docs.select("doc_id", text_bytes().alias("t")), "doc_id long, n_bytes long, media binary", rows, 64)


def landmark_column(stored: DataFrame) -> DataFrame:
    """doc_id and the time-coded landmark array of each WAV file."""

    def rows(source):
        for doc_id, media in source:
            yield doc_id, fingerprint(from_wav(media))[1].tolist() if media else []

    return per_row(stored.select("doc_id", "media"), "doc_id long, landmarks array<long>", rows, 64)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text's payload, reads it back, digests what was read and the stored form, and gives the time-coded
    landmark array beside its digest (`feature`: peaks, landmarks, hash)."""

    def rows(source):
        for doc_id, raw in source:
            media = to_wav(pad(raw))
            payload = from_wav(media)
            count, marks = fingerprint(payload)
            feature = f"{count}:{len(marks)}:{hashlib.sha256(marks.astype('<i8').tobytes()).hexdigest()[:32]}"
            yield doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, marks.tolist()

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, landmarks array<long>"
    return per_row(docs.select("doc_id", text_bytes().alias("t")), schema, rows, 64)

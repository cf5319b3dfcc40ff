"""Media columns: texts as 8-bit WAV samples, and spectral-peak pair fingerprints of their short-time spectrum.

A text's UTF-8, padded with spaces to a positive multiple of 192 bytes, is stored by the wave module as one unsigned
8-bit channel; what the module reads back gives the features. Frames of FRAME samples, centred HOP apart from the first
sample on, are transformed under a Hann window, so that every sample counts in full; beyond the ends is
silence at the level of the frame's samples. A frame's peaks are the strongest local maxima of its magnitudes, and each is paired with peaks of the next
frames: (frequency, frequency, frame distance) packed in an integer, with the frame as its time code.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, texts

UNIT = 192
RATE = 8000
FRAME = 128
HOP = 32
#: Peaks of a frame, and frames ahead that they are paired with.
PEAKS = 2
AHEAD = 2
#: Frames that are transformed at a time.
BLOCK = 4096


def payload_of(data: bytes | None) -> bytes:
    data = data or b""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


def encode(payload: bytes) -> bytes:
    """A WAV file of the payload's bytes as 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.setnframes(len(payload))
        w.writeframesraw(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    """The samples of an 8-bit WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("one channel of 8 bits is expected")
        return w.readframes(w.getnframes())


def peaks_of(samples: bytes) -> np.ndarray:
    """Frequencies of each frame's peaks, strongest first: frames x PEAKS; 0 where a frame has fewer."""
    x = np.frombuffer(samples, np.uint8)
    x, lo, hi = np.pad(x, FRAME // 2), FRAME // 2, FRAME // 2 + len(x)
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    window, out = np.hanning(FRAME).astype(np.float32), np.zeros((n, PEAKS), np.int64)
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        part = np.zeros((m - 1) * HOP + FRAME, np.uint8)
        part[: len(x) - at * HOP] = x[at * HOP : at * HOP + len(part)]
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP].astype(np.float32) - 128
        start = (at + np.arange(m)) * HOP
        for i in np.flatnonzero((start < lo) | (start + FRAME > hi)):  # the first and last ones: silence beyond the ends
            a, b = max(lo - start[i], 0), min(hi - start[i], FRAME)
            own = frames[i, a:b] - (frames[i, a:b].mean() if b > a else 0)
            frames[i] = 0
            frames[i, a:b] = own
        power = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window, axis=1).astype(np.complex64))
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        for k in range(PEAKS):
            f = top.argmax(axis=1)
            rows = np.arange(m)
            out[at : at + m, k] = np.where(top[rows, f] > 1e-3, f + 1, 0)
            top[rows, f] = 0
    return out


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and packed peak pairs, in order of time."""
    peaks = peaks_of(samples)
    times, codes = [], []
    for d in range(1, AHEAD + 1):
        if len(peaks) <= d:
            break
        a, b = peaks[:-d, :, None], peaks[d:, None, :]
        code = (a << 16 | b << 8 | d).reshape(len(peaks) - d, -1)
        ok = ((a > 0) & (b > 0)).reshape(code.shape)
        times.append(np.broadcast_to(np.arange(len(code))[:, None], code.shape)[ok])
        codes.append(code[ok])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def describe(t: np.ndarray, c: np.ndarray) -> str:
    """Number of pairs and a digest of times and pairs."""
    return f"{len(t)}:{hashlib.blake2b(t.astype('<i4').tobytes() + c.astype('<i4').tobytes(), digest_size=12).hexdigest()}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_times array<int>, peak_pairs array<int>"


def fingerprints(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """For every row of docs its stored form's digests and its fingerprint as time-coded arrays; and the WAV if asked.

    Null texts count as empty, which is one unit of spaces. Rows are independent, whatever their ids, so repeated rows
    and ties give repeated results. A text's memory is a few times its size.
    """
    names = [x.split()[0] for x in COLUMNS.split(", ")] + ["media"] * with_media

    def run(batches):
        for b in batches:
            rows = []
            for data in as_bytes(b.column(1)):
                media = encode(payload_of(data))
                back = decode(media)
                t, c = fingerprint(back)
                rows.append((len(data or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(t, c), t, c, *([media] if with_media else [])))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                cols = [pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    return texts(docs).mapInArrow(run, COLUMNS + ", media binary" * with_media)

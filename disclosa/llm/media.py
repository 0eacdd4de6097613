"""Media columns: texts held as WAV files, spectra and spectral-peak fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, id_text, stored, utf8

RATE, FRAME, HOP = 8000, 256, 128
BANDS, FAN, REACH = 4, 3, 31
#: Frames transformed together; bounds memory for texts of any length.
BLOCK = 2048
_WINDOW = np.hanning(FRAME + 1)[:-1]


def pad(data: bytes, unit: int = 64) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples; lossless, for a sample is a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum(payload: bytes):
    """Blocks of power spectra, FRAME // 2 bins (without the mean) for each hop."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    x -= 128
    x /= 128
    missing = max(0, FRAME - len(x))
    missing += -(len(x) + missing - FRAME) % HOP
    x = np.concatenate([x, np.zeros(missing, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for i in range(0, len(frames), BLOCK):
        f = np.fft.rfft(frames[i : i + BLOCK] * _WINDOW, axis=1)[:, 1:]
        yield f.real**2 + f.imag**2


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, bin) of the peaks, by frame and bin, and the number of frames.

    A peak is the strongest bin of a band (the lowest on ties) that is at
    least as strong as that band's strongest in the frame before, and stronger
    than that in the frame after.
    """
    bins, power = [], []
    for p in spectrum(payload):
        bands = p.reshape(len(p), BANDS, -1)
        bins.append(bands.argmax(2))
        power.append(bands.max(2))
    b, p = np.concatenate(bins), np.concatenate(power)
    edge = np.zeros((1, BANDS), p.dtype)
    keep = (p >= np.concatenate([edge, p[:-1]])) & (p > np.concatenate([p[1:], edge])) & (p > 1e-6)
    t, band = np.nonzero(keep)
    return t, b[t, band] + band * (FRAME // 2 // BANDS), len(p)


def fingerprints(payload: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(times, codes) of pairs of a peak with each of the next FAN peaks at most
    REACH frames later, ordered by time and code; numbers of peaks and frames.
    A code holds both bins and the distance in frames."""
    t, f, n = peaks(payload)
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        ok = gap <= REACH
        times.append(t[:-k][ok])
        codes.append((f[:-k][ok] << 12) | (f[k:][ok] << 5) | gap[ok])
    at, code = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((code, at))
    return at[order], code[order], len(t), n


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: str | None = None) -> DataFrame:
    """Store every whole text as a WAV file: doc_id, n_bytes, media (binary), written
    as Parquet ``at`` (by default a new folder in spark.checkpoint.dir) and read back.

    A null or empty text is 64 zero bytes; equal texts give equal files; repeated
    rows repeat; a null doc_id stays null; other columns are left out; an empty
    table gives no rows.  No shuffle.
    """

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for i, j in blocks(off, 4 << 20):
                wav = [to_wav(pad(raw[off[k] : off[k + 1]].tobytes())) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1]), pa.int64()), pa.array(wav, pa.binary())], ["doc_id", "n_bytes", "media"])

    media = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return stored(media, "media", at)


def features(media: DataFrame) -> DataFrame:
    """What stored WAV files (doc_id, n_bytes, media) hold and sound like: doc_id,
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media, n_frames,
    n_peaks, n_pairs, pairs_sha256, and the time-coded fingerprint: times and codes
    (array<int>).

    The payload is read back from the file.  Silence (a null or empty text, at full
    negative swing) has no peaks; a row without media has null in all but doc_id,
    n_bytes and media; repeated rows repeat; an empty table gives no rows.  No shuffle.
    """
    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("n_frames", pa.int64()), ("n_peaks", pa.int64()), ("n_pairs", pa.int64()), ("pairs_sha256", pa.string()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]

    def row(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(kinds)
        back = from_wav(media)
        times, codes, n_peaks, n_frames = fingerprints(back)
        sha = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), n_frames, n_peaks, len(times), sha, times, codes

    def run(batches):
        for batch in batches:
            _, off = utf8(batch.column(2))
            for i, j in blocks(off, 4 << 20):
                part = batch.slice(i, j - i)
                cols = zip(*[row(m.as_py()) for m in part.column(2)])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, (_, t) in zip(cols, kinds))], ["doc_id", "n_bytes", "media", *(k for k, _ in kinds)])

    names = {"int64": "long", "string": "string"}
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, " + ", ".join(f"{k} {names.get(str(t), 'array<int>')}" for k, t in kinds))

"""Audio columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis segmentation.

A recording is 8-bit mono PCM in a WAV container. Samples are resampled by a rational factor with
a polyphase windowed-sinc filter (only the outputs that are kept are computed), cut into
overlapped Hann frames, and turned into log-mel energies. A frame energy above the high threshold opens
a segment, one below the low threshold closes it. Segments are cut into blocks of a fixed number of
frames; each block is one row with its time span and a tensor of shape (FRAMES, MELS), the last one of a segment padded
with the floor value.

Recordings are worked through in pieces of fixed size, so memory is bounded by a recording's own bytes plus
a constant. Everything runs in mapInArrow without a shuffle; a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8

RATE, TARGET = 16_000, 8_000
TAPS = 8  # of the filter on each side, in input samples
WINDOW, HOP, FFT, MELS, FRAMES = 200, 80, 256, 24, 32
HIGH, LOW = 0.75, 0.45  # thresholds, as a share of the way from the least to the largest frame energy
FLOOR = np.float32(np.log(1e-6))
PIECE = 4096  # frames worked on at once
HEADER = 44


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM in RIFF/WAVE; every byte is a sample, so this loses nothing. Odd lengths get RIFF's pad byte."""
    n = len(samples)
    head = b"RIFF" + struct.pack("<I", (36 + n + n % 2) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", n) + samples + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file as to_wav() writes it; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, RATE
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        if kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def polyphase(up: int, down: int) -> np.ndarray:
    """The filter's taps by output phase: row p serves outputs whose place in the input is p / up past a sample."""
    cut = min(1.0, up / down)
    at = np.arange(-TAPS + 1, TAPS + 1)[None, :] - (np.arange(up) / up)[:, None]
    taps = cut * np.sinc(cut * at) * np.cos(np.pi * at / (2 * TAPS + 2)) ** 2
    return (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, first: int, count: int) -> np.ndarray:
    """Outputs first .. first + count - 1 of x (numbers, or 8-bit samples) resampled by up / down; zeros lie beyond both ends."""
    taps = polyphase(up, down)
    out = np.empty(count, np.float32)
    for k in range(min(up, count)):  # outputs k, k + up, ... share a phase and lie `down` samples apart
        place, phase = divmod((first + k) * down, up)
        n = (count - k + up - 1) // up
        lo, hi = place - TAPS + 1, place + (n - 1) * down + TAPS + 1
        part = x[max(lo, 0) : max(min(hi, len(x)), 0)]
        part = (part.astype(np.float32) - 128) / 128 if part.dtype == np.uint8 else part
        part = np.pad(part, (max(0, -lo), hi - lo - len(part) - max(0, -lo)))
        rows = np.lib.stride_tricks.as_strided(part, (n, 2 * TAPS), (part.strides[0] * down, part.strides[0]))
        out[k::up] = np.einsum("ij,j->i", rows, taps[phase])
    return out


@lru_cache(8)
def mel_bank(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the FFT's bins."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (bins[None] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    fall = (hz[2:, None] - bins[None]) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def log_mel(samples: bytes, rate: int = RATE, target: int = TARGET) -> np.ndarray:
    """Log-mel energies, float32 of shape (frames, MELS); a last frame that sticks out is filled with zeros."""
    step = int(np.gcd(rate, target))
    up, down = target // step, rate // step
    x = np.frombuffer(samples, np.uint8)
    total = -(-len(x) * up // down)
    frames = max(1, -(-max(0, total - WINDOW) // HOP) + 1)
    window, bank = np.hanning(WINDOW).astype(np.float32), mel_bank(target)
    out = np.empty((frames, MELS), np.float32)
    for a in range(0, frames, PIECE):
        n = min(PIECE, frames - a)
        need = (n - 1) * HOP + WINDOW
        y = resample(x, up, down, a * HOP, max(0, min(need, total - a * HOP)))
        y = np.pad(y, (0, need - len(y)))
        rows = np.lib.stride_tricks.as_strided(y, (n, WINDOW), (y.strides[0] * HOP, y.strides[0]))
        power = np.abs(np.fft.rfft(rows * window, FFT)) ** 2
        out[a : a + n] = np.log(np.maximum(power.astype(np.float32) @ bank, np.float32(1e-6)))
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """(first, end) frames of the segments: opened at HIGH, kept while not under LOW; shape (n, 2)."""
    lo, hi = float(energy.min()), float(energy.max())
    if hi - lo < 1e-6:
        return np.array([[0, len(energy)]])
    keep, opens = energy >= lo + LOW * (hi - lo), energy >= lo + HIGH * (hi - lo)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    seen = np.concatenate([[0], np.cumsum(opens)])
    runs = runs[seen[runs[:, 1]] > seen[runs[:, 0]]].copy()
    first_open = np.searchsorted(seen, seen[runs[:, 0]], side="right") - 1  # a segment begins where it is opened
    runs[:, 0] = first_open
    return runs


def spans(found: np.ndarray, target: int = TARGET) -> list[tuple[float, float]]:
    """Seconds from the first frame's start to the last frame's end."""
    return [(a * HOP / target, ((b - 1) * HOP + WINDOW) / target) for a, b in found.tolist()]


def blocks(mel: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(segment, first frame, tensor) with tensors of shape (FRAMES, MELS)."""
    for k, (a, b) in enumerate(found.tolist()):
        for at in range(a, b, FRAMES):
            tensor = np.full((FRAMES, MELS), FLOOR, np.float32)
            part = mel[at : min(at + FRAMES, b)]
            tensor[: len(part)] = part
            yield k, at, tensor


def audio_tensors(df: DataFrame, *, media: str, key: str) -> DataFrame:
    """One row per block: key, segment, start_s, end_s, tensor (FRAMES * MELS floats, row by row).

    Null media have no rows. to_tensor() makes an Arrow fixed-shape tensor column of the last one.
    Repeated rows give repeated blocks; the key may be null or repeated.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, m in zip(batch.column(0), batch.column(1), strict=True):
                if not m.is_valid:
                    continue
                samples, rate = from_wav(m.as_py())
                mel = log_mel(samples, rate)
                found = segments(mel.mean(1))
                rows = []
                for segment, at, tensor in blocks(mel, found):
                    rows.append((segment, at * HOP / TARGET, (min(at + FRAMES, found[segment][1]) - 1) * HOP / TARGET + WINDOW / TARGET, tensor.ravel()))
                    if len(rows) == 512:
                        yield pack(batch.schema.field(0).type, k, rows)
                        rows = []
                if rows:
                    yield pack(batch.schema.field(0).type, k, rows)

    def pack(kind, k, rows):
        n = len(rows)
        values = pa.array(np.concatenate([r[3] for r in rows]))
        tensor = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * FRAMES * MELS), values)
        return pa.RecordBatch.from_arrays(
            [pa.array([k.as_py()] * n, kind), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64()), tensor],
            ["key", "segment", "start_s", "end_s", "tensor"],
        )

    return df.select(df[key], df[media]).mapInArrow(run, f"key {kind}, segment long, start_s double, end_s double, tensor array<float>").withColumnRenamed("key", key)


def to_tensor(column: pa.Array | pa.ChunkedArray) -> pa.ExtensionArray:
    """The tensor column of audio_tensors() as an Arrow fixed-shape tensor array (FRAMES, MELS)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.FixedSizeListArray.from_arrays(column.flatten(), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)), flat)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long"


def feature_text(mel: np.ndarray, found: np.ndarray) -> str:
    """SHA-256 over the block tensors (rounded to 1/64) and the spans in frames."""
    digest = hashlib.sha256(found.astype("<i8").tobytes())
    for _, _, tensor in blocks(mel, found):
        digest.update(np.rint(tensor * 64).astype("<i4").tobytes())
    return digest.hexdigest()


def text_as_audio(df: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text's UTF-8 bytes, zero-filled to a positive multiple of 64, as WAV samples, reads the file
    back and computes features; one row per row of `df`, with the columns of DIGEST.

    Null texts are empty ones (64 zero bytes); null ids stay null; repeated rows give repeated, equal results.
    """

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            raw, rows = data.tobytes(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                body = raw[a:b]
                media = to_wav(body + b"\0" * (-len(body) % 64 or 64 * (not body)))
                samples, rate = from_wav(media)
                mel = log_mel(samples, rate)
                found = segments(mel.mean(1))
                rows.append((b - a, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(mel, found), len(mel), len(found)))
            names = [c.split()[0] for c in DIGEST.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.string() if "string" in c else pa.int64() for c in DIGEST.split(", ")[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return df.select(df[id_column].cast("long").alias("doc_id"), df[text]).mapInArrow(run, DIGEST)

"""Audio features: polyphase resampling, log-mel frames, energy segments.

Samples are kept losslessly as 8-bit WAV files in a binary column. Features come
from the stored bytes: a polyphase filter changes the rate, overlapped windows
give log-mel frames, frames are dealt into tensors of one fixed shape, held as an
Arrow stream of a fixed-shape tensor column beside the time span each covers, and a
two-threshold (hysteresis) walk over frame energies
marks active segments. Every file is processed on its own, so equal bytes give
equal features, whatever else is in the batch.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import sliced
from tidemark.llm.scratch import Scratch

UNIT = 64


@dataclass(frozen=True)
class Settings:
    rate: int = 16_000  # of the stored samples
    to_rate: int = 8_000
    taps: int = 16  # of the resampling filter, to each side of the slower rate
    window: int = 256
    hop: int = 128
    mels: int = 32
    frames: int = 64  # of a tensor
    high: float = 3.0  # dB over the median energy that open a segment
    low: float = 1.0  # dB below which it closes
    gap: int = 3  # frames under ``low`` that a segment survives


def padded(text: bytes | None) -> bytes:
    """Bytes and zeros up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(samples: bytes, rate: int) -> bytes:
    """8-bit unsigned mono PCM in a RIFF file; chunks have even length."""
    pad = len(samples) & 1
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + bytes(pad)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(wav: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono PCM file; other files raise ValueError."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wav, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono PCM only")
        if name == b"data":
            if rate is None or at + 8 + size > len(wav):
                raise ValueError("a WAV file is cut short")
            return wav[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file has no samples")


@lru_cache(maxsize=8)
def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low pass, one row a phase."""
    half = taps * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 8.0)
    h *= up / h.sum()
    width = -(-len(h) // up)
    return np.concatenate((h, np.zeros(width * up - len(h)))).reshape(width, up).T.astype(np.float32)


def resampled(x: np.ndarray, rate: int, to: int, taps: int) -> np.ndarray:
    """Output sample m stands at input time m * rate / to; each uses one phase of
    the filter, and samples beyond the ends count as 0."""
    g = gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return x.astype(np.float32)
    phases = _filter(up, down, taps)
    width, half = phases.shape[1], taps * max(up, down)
    n = -(-len(x) * up // down)
    wide = np.concatenate((np.zeros(width, np.float32), x.astype(np.float32), np.zeros(width, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(wide, width)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):  # outputs of one phase are one strided product
        m = np.arange(first, n, up, dtype=np.int64)
        top = m * down + half
        last, phase = top // up, int(top[0] % up)
        out[first::up] = windows[last - width + 1 + width] @ phases[phase][::-1]
    return out


@lru_cache(maxsize=8)
def _mel(rate: int, window: int, mels: int) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(window // 2 + 1) * rate / window
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)))
    return (bank / np.maximum(bank.sum(axis=1, keepdims=True), 1e-9)).T.astype(np.float32)


def log_mel(x: np.ndarray, s: Settings) -> np.ndarray:
    """(frames, mels) in dB; the last frame is filled with zeros."""
    n = max(1, -(-max(len(x) - s.window, 0) // s.hop) + 1)
    wide = np.zeros((n - 1) * s.hop + s.window, np.float32)
    wide[: len(x)] = x[: len(wide)]
    frames = np.lib.stride_tricks.sliding_window_view(wide, s.window)[:: s.hop] * np.hanning(s.window + 2)[1:-1].astype(np.float32)
    power = np.square(np.abs(np.fft.rfft(frames, axis=1))).astype(np.float32)
    return (10 * np.log10(power @ _mel(s.to_rate, s.window, s.mels) + np.float32(1e-6))).astype(np.float32)


def segments(db: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Frames [start, end) whose energy rises ``high`` over the median and has not
    stayed under ``low`` for more than ``gap`` frames."""
    over = db - np.float32(np.median(db))
    out, start, last = [], None, 0
    events = np.flatnonzero(over >= s.low)
    for i in events.tolist():
        if start is not None and i - last > s.gap + 1:
            out.append((start, last + 1))
            start = None
        if start is None and over[i] >= s.high:
            start = i
        last = i
    if start is not None:
        out.append((start, last + 1))
    return out


def tensor_type(s: Settings) -> pa.FixedShapeTensorType:
    return pa.fixed_shape_tensor(pa.float32(), (s.frames, s.mels))


def to_stream(spans: list[tuple[float, float]], block: np.ndarray, s: Settings) -> bytes:
    """Arrow IPC stream of (start, end, tensor): times in seconds, and tensors of the
    one shape, which the schema states."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(block.ravel(), pa.float32()), s.frames * s.mels)
    tensors = pa.ExtensionArray.from_storage(tensor_type(s), flat)
    starts, ends = zip(*spans, strict=True)
    batch = pa.record_batch([pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), tensors], ["start", "end", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_stream(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(spans, tensors) of ``to_stream``: n x 2, and n x frames x mels."""
    table = pa.ipc.open_stream(raw).read_all().combine_chunks()
    spans = np.stack((table["start"].to_numpy(), table["end"].to_numpy()), axis=1)
    return spans, table["tensor"].chunk(0).to_numpy_ndarray()


def features(wav: bytes, s: Settings) -> dict:
    samples, rate = from_wav(wav)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resampled(x, rate, s.to_rate, s.taps), s)
    seconds = s.hop / s.to_rate
    n = -(-len(mel) // s.frames)
    block = np.full((n * s.frames, s.mels), np.float32(-60))
    block[: len(mel)] = mel
    spans = [(k * s.frames * seconds, min(len(mel), (k + 1) * s.frames) * seconds) for k in range(n)]
    active = [(a * seconds, b * seconds) for a, b in segments(mel.mean(axis=1), s)]
    return {"n_frames": len(mel), "tensors": to_stream(spans, block, s), "segments": [{"start": a, "end": b} for a, b in active]}


_SEGMENTS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
_SQL = "n_frames long, tensors binary, segments array<struct<start:double,end:double>>"


def _featured(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            got = [features(w, s) for w in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch(
                [*b.columns[:-1], pa.array([g["n_frames"] for g in got], pa.int64()), pa.array([g["tensors"] for g in got], pa.binary()), pa.array([g["segments"] for g in got], _SEGMENTS)],
                [*b.schema.names[:-1], "n_frames", "tensors", "segments"],
            )

    return run


def audio_features(files: DataFrame, wav_col: str = "wav", settings: Settings = Settings()) -> DataFrame:
    """``files`` without ``wav_col``, and n_frames, tensors (an Arrow stream, see
    ``to_stream``: ``frames`` x ``mels`` 32-bit floats in dB) and active segments
    (start, end in seconds). Columns of these three names are replaced, others stay.
    A file that is no 8-bit mono WAV raises; a file of no samples has one frame of
    silence; very long files give more tensors; repeated rows stay; no rows give
    none."""
    keep = [c for c in files.columns if c not in (wav_col, "n_frames", "tensors", "segments")]
    fields = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select(*[F.col(f"`{c}`") for c in [*keep, wav_col]]).mapInArrow(_featured(settings), f"{fields}{_SQL}")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 64):
        out = []
        for frames, raw, active in zip(*(b.column(i).to_pylist() for i in range(b.num_columns - 3, b.num_columns)), strict=True):
            spans, tensors = from_stream(raw)
            held = hashlib.sha256(spans.astype("<f8").tobytes() + tensors.astype("<f4").tobytes()).hexdigest()
            times = hashlib.sha256(np.array([(t["start"], t["end"]) for t in active], "<f8").tobytes()).hexdigest()
            out.append(f"{frames}:{len(tensors)}:{held}:{len(active)}:{times}")
        yield pa.record_batch([*b.columns[:-3], pa.array(out, pa.string())], [*b.schema.names[:-3], "feature"])


def digested(found: DataFrame) -> DataFrame:
    """``found`` of ``audio_features`` with one text, feature, in the place of its
    three columns, computed from the tensors and spans as they were read."""
    keep = [c for c in found.columns if c not in ("n_frames", "tensors", "segments", "feature")]
    fields = "".join(f"`{c}` {found.schema[c].dataType.simpleString()}, " for c in keep)
    return found.select(*[F.col(f"`{c}`") for c in [*keep, "n_frames", "tensors", "segments"]]).mapInArrow(_digested, f"{fields}feature string")


def _stored(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            wavs = [to_wav(padded(t), rate) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([len(t or b"") for t in b.column(1).to_pylist()], pa.int64()), pa.array(wavs, pa.binary())], ["doc_id", "n_bytes", "wav"])

    return run


def store(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Texts as WAV files: (doc_id, n_bytes, wav), written and read back. Null text
    is empty and gives one unit of zeros."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return Scratch(docs.sparkSession, "media").stage(text.mapInArrow(_stored(settings.rate), "doc_id long, n_bytes long, wav binary"), "wav")


def samples(wav: str = "wav") -> Column:
    """SQL of the samples of a file that ``to_wav`` made: what stands behind the
    header, as long as the header says."""
    size = sum(F.conv(F.hex(F.substring(wav, 41 + i, 1)), 16, 10).cast("bigint") * (1 << 8 * i) for i in range(4)).cast("int")
    return F.substring(F.col(wav), F.lit(45), size)

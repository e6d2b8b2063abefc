"""Media columns: audio clips and their features.

A clip is stored as a RIFF/WAVE file of 8-bit samples (mono, ``RATE`` a second),
which keeps every sample value, so any bytes can be carried as a payload.  From
the samples that are read back come

* a polyphase resampling to ``RATE * UP / DOWN``: a low-pass filter dealt into
  ``UP`` phases, each output sample touching the taps of its own phase only;
* log-mel filterbank energies of overlapping frames, cut into tensors of the
  fixed shape ``(FRAMES, MELS)`` (the last one padded with the floor value),
  each with the time span in seconds that it covers;
* segments of sound by hysteresis: one opens where the frame energy rises over
  the upper level and closes where it falls under the lower one.

:func:`clips` gives these as columns.  Spark has no type of fixed shape, so a tensor
is stored as the bytes of its Arrow fixed-shape tensor storage (FRAMES * MELS
32-bit floats, little-endian), and the column's metadata states shape and type;
:func:`tensor_array` makes the Arrow column of what is read back.

Defined cases: a null or empty text is a clip of ``UNIT`` bytes of value 255;
equal texts have equal values, as each clip is computed on its own; very long
texts are read in blocks of frames; repeated rows each get a row.  Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwater.llm.common import batch_map, read_table, text_bytes

UNIT = 576
RATE, UP, DOWN, TAPS = 8000, 2, 5, 20
SIZE, HOP, MELS, FRAMES = 256, 128, 16, 32
FLOOR = float(np.log(np.float32(1e-6)))
#: Levels of the hysteresis, in standard deviations over the clip's mean frame energy.
OPEN, CLOSE = 0.5, -0.25
#: Frames computed at a time.
BLOCK = 2048


def payload(raw: bytes) -> bytes:
    """The text's bytes, filled up with bytes 255 to a positive multiple of ``UNIT``."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\xff")


def to_wave(samples: bytes) -> bytes:
    odd = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def from_wave(stored: bytes) -> bytes:
    """The samples of a RIFF/WAVE file, found by its chunks."""
    data = io.BytesIO(stored)
    if struct.unpack("<4sI4s", data.read(12))[::2] != (b"RIFF", b"WAVE"):
        raise ValueError("not a RIFF/WAVE file")
    while head := data.read(8):
        name, size = struct.unpack("<4sI", head)
        body = data.read(size + size % 2)
        if name == b"data":
            return body[:size]
    raise ValueError("no data chunk")


def _phases() -> np.ndarray:
    """Taps by phase, shape (TAPS, UP): a windowed sinc at the narrower of the two bands."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    taps = np.sinc(cut * t) * np.hamming(n)
    taps *= UP / taps.sum()
    return taps.reshape(TAPS, UP)[::-1].astype(np.float32)


def _mel_bank() -> np.ndarray:
    """Triangular filters of equal width in mel, shape (SIZE // 2 + 1, MELS)."""
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.arange(SIZE // 2 + 1) * (RATE * UP / DOWN / SIZE)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


PHASES, BANK, WINDOW = _phases(), _mel_bank(), np.hanning(SIZE).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN; ceil(len(x) * UP / DOWN) samples."""
    n = -(-len(x) * UP // DOWN)
    padded = np.pad(x, (TAPS // 2, TAPS + DOWN))
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(-(-n // UP) * UP, np.float32)
    for k in range(UP):  # output i = UP * j + k stands at input i * DOWN / UP
        start, phase = divmod(k * DOWN, UP)
        out[k::UP] = windows[start::DOWN][: len(out[k::UP])] @ PHASES[:, phase]
    return out[:n]


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames, MELS) and energies (frames) of frames of SIZE samples every HOP."""
    n = max(1, -(-(len(x) - SIZE) // HOP) + 1)
    x = np.pad(x, (0, (n - 1) * HOP + SIZE - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, SIZE)[::HOP]
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, BLOCK):
        part = frames[a : a + BLOCK] * WINDOW
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[a : a + BLOCK] = np.log(np.maximum(power.astype(np.float32) @ BANK, np.float32(1e-6)))
        energy[a : a + BLOCK] = np.einsum("ij,ij->i", part, part)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] frames of sound by hysteresis on the energies."""
    mean, std = float(energy.mean()), float(energy.std())
    up, down = energy > mean + OPEN * std, energy < mean + CLOSE * std
    event = np.where(up, 1, np.where(down, -1, 0))
    at = np.flatnonzero(event)
    kept = at[np.r_[True, event[at][1:] != event[at][:-1]]] if len(at) else at
    if len(kept) and event[kept[0]] < 0:
        kept = kept[1:]
    ends = np.append(kept[1::2] - 1, len(energy) - 1)
    return list(zip(kept[::2].tolist(), ends.tolist(), strict=False))


def analyse(stored: bytes) -> dict:
    """All features of a stored clip."""
    x = (np.frombuffer(from_wave(stored), np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x))
    full = -(-len(mels) // FRAMES) * FRAMES
    tensors = np.full((full, MELS), FLOOR, np.float32)
    tensors[: len(mels)] = mels
    second = HOP * DOWN / (RATE * UP)
    spans = [(a * second, (min(a + FRAMES, len(mels)) - 1) * second + SIZE / HOP * second) for a in range(0, full, FRAMES)]
    sound = [(a * second, (b + SIZE / HOP) * second) for a, b in segments(energy)]
    return {"tensors": tensors.reshape(-1, FRAMES, MELS), "frames": len(mels), "spans": spans, "segments": sound}


#: What the tensors' column says of its values.
FORM = {"extension": "arrow.fixed_shape_tensor", "shape": [FRAMES, MELS], "type": "float32"}


def tensor_array(values: list[bytes]) -> pa.FixedShapeTensorArray:
    """Arrow's fixed-shape tensor column over stored tensors."""
    floats = pa.Array.from_buffers(pa.float32(), len(values) * FRAMES * MELS, [None, pa.py_buffer(b"".join(values))])
    storage = pa.FixedSizeListArray.from_arrays(floats, FRAMES * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS]), storage)


def clip(raw: bytes) -> tuple[bytes, int, list[dict], list[dict]]:
    """The stored clip of a text, and frames, tensors and segments of what is read back from it."""
    media = to_wave(payload(raw))
    got = analyse(media)
    tensors = [{"start": a, "end": b, "values": v.tobytes()} for (a, b), v in zip(got["spans"], got["tensors"].astype("<f4", copy=False), strict=True)]
    return media, got["frames"], tensors, [{"start": a, "end": b} for a, b in got["segments"]]


def clips(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, media (WAVE), frames (their number), tensors (start and end in seconds, values) and segments (start and end)."""
    schema = "media binary, frames int, tensors array<struct<start: double, end: double, `values`: binary>>, segments array<struct<start: double, end: double>>"
    made = batch_map(docs.select("*", text_bytes().alias("_tarnwater_raw")), lambda: lambda raws: [clip(r) for r in raws], schema, keep, ["_tarnwater_raw"])
    return made.withMetadata("tensors", FORM)


def digest(media: bytes, frames: int, tensors: list[dict], segments: list[dict]) -> tuple:
    """What a clip's columns hold, as numbers, hashes and a short text."""
    back = from_wave(media)
    sound = sum([s["end"] - s["start"] for s in segments])
    mels = tensor_array([t["values"] for t in tensors]).to_numpy_ndarray().reshape(-1, MELS)[:frames]
    summary = ",".join([f"{v:.2f}" for v in mels.mean(axis=0).tolist()])
    feature = f"frames={frames};tensors={len(tensors)}x{FRAMES}x{MELS};segments={len(segments)};sound={sound:.3f};logmel={summary}"
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.length(text_bytes()).cast("bigint").alias("n_bytes"))
    schema = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    columns = ["media", "frames", "tensors", "segments"]
    return batch_map(clips(docs, ["doc_id", "n_bytes"]), lambda: lambda *c: [digest(*x) for x in zip(*c, strict=True)], schema, ["doc_id", "n_bytes"], columns)


QUERIES = {"op9_audio_features": op9_audio_features}
ORACLES: dict[str, str] = {}

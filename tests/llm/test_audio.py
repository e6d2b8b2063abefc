import hashlib
import zlib

import numpy as np
import pytest

from tarnwater.llm import audio as m


@pytest.mark.parametrize("raw", [b"", b"a", b"x" * 576, b"x" * 577, bytes(range(256)) * 700])
def test_round_trip(raw):
    p = m.payload(raw)
    assert len(p) % 576 == 0 and p and p[: len(raw)] == raw and set(p[len(raw) :]) <= {255}
    assert m.from_wave(m.to_wave(p)) == p
    assert m.from_wave(m.to_wave(p + b"z")) == p + b"z"
    size, sha, tail, media, media_sha, feature = m.digest(*m.clip(raw))
    assert (size, sha, tail) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert (media, media_sha) == (len(m.to_wave(p)), hashlib.sha256(m.to_wave(p)).hexdigest())
    if len(raw) < 2000:
        assert feature == direct_feature(p)


def direct_feature(p):
    """The feature text by definition: direct convolution, a discrete Fourier transform by sums, a state machine."""
    x = [(v - 128) / 128 for v in p]
    n, half = m.TAPS * m.UP, m.TAPS // 2
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(m.UP, m.DOWN)) * np.hamming(n)
    taps *= m.UP / taps.sum()
    y = []
    for i in range(-(-len(x) * m.UP // m.DOWN)):
        start, phase = divmod(i * m.DOWN, m.UP)
        reach = [(start - half + j, taps[(m.TAPS - 1 - j) * m.UP + phase]) for j in range(m.TAPS)]
        y.append(sum(x[k] * w for k, w in reach if 0 <= k < len(x)))
    frames = max(1, -(-(len(y) - m.SIZE) // m.HOP) + 1)
    y += [0.0] * ((frames - 1) * m.HOP + m.SIZE - len(y))
    k = np.arange(m.SIZE)
    dft = np.exp(-2j * np.pi * np.outer(k, np.arange(m.SIZE // 2 + 1)) / m.SIZE)
    parts = [np.array(y[f * m.HOP : f * m.HOP + m.SIZE]) * np.hanning(m.SIZE) for f in range(frames)]
    mels = np.log(np.maximum(np.array([np.abs(q @ dft) ** 2 @ m.BANK for q in parts]), 1e-6))
    energy = np.array([(q**2).sum() for q in parts])
    sound, count, opened = 0.0, 0, None
    for f, e in enumerate([*energy, None]):
        if opened is None and e is not None and e > energy.mean() + m.OPEN * energy.std():
            opened, count = f, count + 1
        elif opened is not None and (e is None or e < energy.mean() + m.CLOSE * energy.std()):
            sound, opened = sound + (f - 1 + m.SIZE / m.HOP - opened) * m.HOP * m.DOWN / (m.RATE * m.UP), None
    mean = ",".join(f"{v:.2f}" for v in mels.mean(axis=0))
    return f"frames={frames};tensors={-(-frames // m.FRAMES)}x{m.FRAMES}x{m.MELS};segments={count};sound={sound:.3f};logmel={mean}"


def test_resampling_against_direct_form():
    x = np.random.default_rng(1).standard_normal(300).astype(np.float32)
    taps = m.PHASES[::-1].reshape(-1)  # the filter at UP times the rate
    up = np.zeros(len(x) * m.UP)
    up[:: m.UP] = x
    full = np.convolve(up, taps)
    got = m.resample(x)
    best = max(range(-60, 60), key=lambda d: np.corrcoef(np.roll(full, d)[:: m.DOWN][20:100], got[20:100])[0, 1])
    want = np.roll(full, best)[:: m.DOWN][: len(got)]
    assert len(got) == -(-len(x) * m.UP // m.DOWN) and np.allclose(want[20:100], got[20:100], atol=1e-4)


def test_tone_lands_in_its_band_and_segment():
    t = np.arange(8000) / m.RATE
    tone = np.where((t > 0.3) & (t < 0.6), np.sin(2 * np.pi * 700 * t), 0)
    got = m.analyse(m.to_wave((128 + 100 * tone).astype(np.uint8).tobytes()))
    (a, b), = got["segments"]
    assert 0.2 < a < 0.35 and 0.55 < b < 0.75
    loud = got["tensors"].reshape(-1, m.MELS)[: got["frames"]].argmax(axis=1)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    assert abs(np.median(loud[10:14]) - (mel(700) / mel(1600) * (m.MELS + 1) - 1)) <= 1
    assert got["tensors"].shape[1:] == (m.FRAMES, m.MELS) 
    assert m.segments(np.zeros(5, np.float32)) == []


def test_query(spark, table):
    rows = [(1, None), (2, ""), (3, "é" * 40_000), (3, "é" * 40_000), (None, "x" * 1000)]
    folder = table("documents", spark.createDataFrame([(*r, "m") for r in rows], "doc_id bigint, text string, media_bytes string"))
    got = m.op9_audio_features(spark, folder).collect()
    assert sorted((r.doc_id or 0, *r[1:]) for r in got) == sorted((i or 0, len((t or "").encode()), *m.digest(*m.clip((t or "").encode()))) for i, t in rows)
    m.clips(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"]).write.parquet(f"{folder}/clips.parquet")
    stored = spark.read.parquet(f"{folder}/clips.parquet")  # shape and values outlive the file
    assert stored.schema["tensors"].metadata == m.FORM
    clip = stored.where("doc_id = 1").first()
    assert len(clip.media) == 576 + 44 and clip.tensors[0].start == 0
    back = m.tensor_array([bytes(t["values"]) for t in clip.tensors])
    assert back.type.shape == [m.FRAMES, m.MELS] and np.array_equal(back.to_numpy_ndarray(), m.analyse(m.to_wave(m.payload(b"")))["tensors"])
    assert m.op9_audio_features(spark, table("documents", spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import media
from tidemark.llm.queries import op9_media

S = media.Settings()


def test_wav_round_trip_and_standard_reader():
    for n in (0, 1, 64, 1001):
        raw = bytes(range(256)) * 4
        wav = media.to_wav(raw[:n], 16000)
        assert media.from_wav(wav) == (raw[:n], 16000)
        with wave.open(io.BytesIO(wav)) as w:
            assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(2000)) == (16000, 1, 1, raw[:n])
    for bad in (b"", b"RIFF", media.to_wav(b"abcd", 8000)[:-2]):
        with pytest.raises(ValueError):
            media.from_wav(bad)


def test_resampling_equals_direct_sum():
    r = np.random.default_rng(1)
    for rate, to in ((16000, 8000), (8000, 16000), (12000, 8000), (8000, 12000), (8000, 8000)):
        for n in (1, 5, 300):
            x = r.normal(size=n).astype(np.float32)
            got = media.resampled(x, rate, to, 4)
            g = np.gcd(rate, to)
            up, down = to // g, rate // g
            assert len(got) == -(-n * up // down)
            if up == down:
                assert (got == x).all()
                continue
            h = media._filter(up, down, 4).T.ravel()
            half = 4 * max(up, down)
            for m in range(len(got)):
                want = sum(x[i] * h[m * down - i * up + half] for i in range(n) if 0 <= m * down - i * up + half < len(h))
                assert abs(got[m] - want) < 1e-4


def test_tone_stands_in_its_band_and_high_tones_go():
    t = np.arange(16000) / 16000
    low, high = (media.resampled(np.sin(2 * np.pi * f * t), 16000, 8000, S.taps) for f in (1000, 7000))
    assert np.square(high[100:-100]).mean() < 1e-4 < np.square(low[100:-100]).mean()
    mel = media.log_mel(low, S)
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), S.mels + 2) / 2595) - 1)
    band = int(mel[5:-5].mean(axis=0).argmax())
    assert edges[band] <= 1000 <= edges[band + 2]


def test_segments():
    db = np.array([0, 0, 0, 4, 2, 0, 0, 2, 0, 0, 0, 0, 0, 2, 2, 0, 5, 0, 0, 0, 0, 0], float)
    assert media.segments(db, S) == [(3, 8), (16, 17)]
    assert media.segments(np.zeros(5), S) == []


def test_log_mel_equals_direct_sums():
    s = media.Settings(window=16, hop=8, mels=4)
    x = np.random.default_rng(2).normal(size=70).astype(np.float32)
    got = media.log_mel(x, s)
    n = -(-(len(x) - s.window) // s.hop) + 1
    assert got.shape == (n, s.mels)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    top = 2595 * np.log10(1 + s.to_rate / 2 / 700)
    edges = [hz(top * i / (s.mels + 1)) for i in range(s.mels + 2)]
    for f in range(n):
        frame = [float(x[f * s.hop + i]) if f * s.hop + i < len(x) else 0.0 for i in range(s.window)]
        frame = [v * (0.5 - 0.5 * np.cos(2 * np.pi * (i + 1) / (s.window + 1))) for i, v in enumerate(frame)]
        power = [abs(sum(v * np.exp(-2j * np.pi * k * i / s.window) for i, v in enumerate(frame))) ** 2 for k in range(s.window // 2 + 1)]
        for m in range(s.mels):
            weight = []
            for k in range(len(power)):
                at = k * s.to_rate / s.window
                weight.append(max(0.0, min((at - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - at) / (edges[m + 2] - edges[m + 1]))))
            want = 10 * np.log10(sum(w * p for w, p in zip(weight, power, strict=True)) / max(sum(weight), 1e-9) + 1e-6)
            assert abs(got[f, m] - want) < 1e-2


def test_tensors_have_one_shape():
    f = media.features(media.to_wav(bytes(range(256)) * 300, S.rate), S)
    assert f["n_frames"] == -(-(38400 - S.window) // S.hop) + 1
    schema = pa.ipc.open_stream(f["tensors"]).schema
    assert schema.field("tensor").type == media.tensor_type(S) and tuple(schema.field("tensor").type.shape) == (S.frames, S.mels)
    spans, tensors = media.from_stream(f["tensors"])
    assert tensors.shape == (-(-f["n_frames"] // S.frames), S.frames, S.mels) and spans.shape == (len(tensors), 2)
    seconds = S.hop / S.to_rate
    assert np.allclose(spans[:, 0], np.arange(len(tensors)) * S.frames * seconds) and np.isclose(spans[-1, 1], f["n_frames"] * seconds)
    x = (np.frombuffer(bytes(range(256)) * 300, np.uint8).astype(np.float32) - 128) / 128
    mel = media.log_mel(media.resampled(x, S.rate, S.to_rate, S.taps), S)
    assert (tensors.reshape(-1, S.mels)[: len(mel)] == mel).all()


def test_query_and_defined_cases(spark, tmp_path):
    texts = [None, "", "a", "é" * 40, "x" * 64, "b" * 100_000, "same words here", "same words here", "y" * 49_600, "z" * 33_000]
    rows = [(i, t, 2) for i, t in enumerate(texts)] + [(None, "n", 1), (3, "é" * 40, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, wav int").write.parquet(str(tmp_path / "documents.parquet"))
    out = op9_media(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        raw = media.padded(text.encode())
        wav = media.to_wav(raw, S.rate)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text.encode()), len(raw), hashlib.sha256(raw).hexdigest())
        assert r.tail_crc32 == zlib.crc32(raw[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert by.setdefault(text, r.feature) == r.feature
    assert len(set(by.values())) >= 6
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert op9_media(spark, str(tmp_path / "e")).count() == 0

"""Live-session folds, incremental features, settings and reports."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.functions import signal, text as T
from phonolith.operators import stats
from phonolith.sources import wav
from phonolith.streaming import session as S


def test_ring():
    r = S.Ring(8)
    r.write([0, 1, 2, 3])
    r.write([4, 5, 6, 7, 8])
    assert (r.base, r.end, r.read(2, 9)) == (1, 9, [2, 3, 4, 5, 6, 7, 8])
    for a, b in ((0, 4), (5, 10)):
        with pytest.raises(S.StreamError):
            r.read(a, b)
    r.write(list(range(100)))
    assert r.base == 101 and r.read(108, 109) == [99]


@pytest.mark.parametrize("cuts", [[1000], [1] * 1000, [7] * 142 + [6]])
def test_resampler_ignores_pushes(cuts):
    x = np.sin(np.arange(1000) / 20)
    fold, got, at = S.Resampler(1.5, 16), [], 0
    for n in cuts:
        got += [v for c in fold.step({"samples": x[at : at + n].tolist()}) for v in c["samples"]]
        at += n
    want = np.interp(np.arange(0, 999, 1.5), np.arange(1000), x)
    assert np.allclose(got, want[: len(got)]) and len(got) == len(want) // 16 * 16


def test_layers():
    f = S.Layers(most=3.0, overlap=1.0)
    for i in range(6):
        out = f.step({"sequence": i, "seconds": 1.0, "layers": {"mel": i}})[0]
    assert (out["first"], out["last"], out["seconds"]) == (3, 5, 3.0) and f.chunks[4][1] == {"mel": 4}


def test_transcriber():
    f = S.Transcriber()
    rows = [{"text": "a", "speech": True, "chunk_ms": 400}, {"text": "a b", "speech": False, "chunk_ms": 100}, {"text": "a b.", "speech": False, "chunk_ms": 400}]
    assert [f.step(r)[0]["kind"] for r in rows] == ["partial", "partial", "final"]
    with pytest.raises(S.StreamError):
        f.step(rows[0])


def test_controller():
    c = S.Controller()
    first = c.step({"base": 0, "end": 48000, "words": [("Hello", 0.0, 0.4), ("there.", 0.5, 0.9), ("More", 1.0, 1.2)], "silence_s": 0.0})
    assert [(o["kind"], o["settled"], o["preview"]) for o in first] == [("partial", "Hello there.", "More")] and c.windows.cursor == 14400
    last = c.step({"base": 0, "end": 49000, "words": [], "silence_s": 1.0})
    assert [(o["kind"], o["settled"]) for o in last] == [("silence-finalize", "More")]


def test_profiles():
    for p in S.PROFILES.values():
        assert all(getattr(p, n) % 16 == 0 for n in ("preroll", "most", "speech", "silence"))
    assert S.PROFILES["realtime"].merged(silence=100.0, preroll=None).silence == 112 and S.PROFILES["realtime"].preroll == 688
    with pytest.raises(TypeError):
        S.Profile().merged(other=1)


def test_incremental_mel():
    x = np.random.default_rng(0).standard_normal(8000).astype(np.float32)
    for n in (1600, 4000, 7999):
        rows, kept, made = signal.mel_more(signal.mel_frames(x[:n])[0], x)
        assert np.allclose(rows, signal.mel_frames(x)[0], atol=1e-6) and kept + made == len(rows) and kept > 0


def test_report(spark):
    rows = [("a", "f1", 0.5), ("a", "f2", 0.1), ("b", "f1", 0.25)]
    got = stats.report(spark.createDataFrame(rows, "model string, file string, wer double"), "model", "file", ["wer"])
    assert [r["line"] for r in got.orderBy("pos").collect()] == ["| model | files | wer |", "| - | - | - |", "| a | 1 | 0.5000 |", "| b | 1 | 0.2500 |"]


@pytest.mark.parametrize(("code", "bits", "body"), [(1, 8, bytes([128, 255, 0])), (1, 24, b"\x00\x00\x40\x00\x00\xc0"), (1, 32, struct.pack("<2i", 1 << 30, -(1 << 31))), (3, 32, struct.pack("<2f", 0.5, -1)), (3, 64, struct.pack("<2d", 0.5, -1))])
def test_wav_formats(code, bits, body):
    extra = b"LIST\x03\x00\x00\x00abc\x00"  # an odd chunk is padded
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, code, 1, 8000, 0, 0, bits)
    data = b"RIFF\x00\x00\x00\x00WAVE" + extra + fmt + b"data" + struct.pack("<I", len(body)) + body
    rate, x = wav.parse(data)
    assert rate == 8000 and np.allclose(x, {8: [0, 127 / 128, -1], 24: [0.5, -0.5], 32: [0.5, -1], 64: [0.5, -1]}[bits])

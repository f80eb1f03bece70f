import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gavelflow.llm.media import MELS, SHAPE, Clip, _filter, from_wav, log_mel, media_table, op9_media_columns, payload, resample, segments

TEXTS = [(1, None), (2, ""), (3, "a"), (4, "é" * 32), (5, "x" * 64), (6, "long text é " * 4000), (6, "x" * 64), (None, "x" * 65), (7, "\0\xff\n")]


def test_payload_round_trip(spark, make_docs):
    got = op9_media_columns(spark, make_docs([(d, t, "en", "s") for d, t in TEXTS])).collect()
    want = []
    for d, t in TEXTS:
        raw = (t or "").encode()
        full = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
        want.append((d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert sorted([tuple(x)[:5] for x in got], key=str) == sorted(want, key=str)
    assert len({x.feature for x in got if x.n_bytes == 64 and x.payload_sha256 == got[0].payload_sha256}) <= 1
    for x in got:
        assert x.media_bytes > x.payload_bytes and len(x.media_sha256) == 64


def test_media_and_tensors(spark, make_docs):
    rows = media_table(spark.read.parquet(make_docs([(6, "sound " * 9000, "en", "s")]) + "/documents.parquet")).collect()
    assert from_wav(rows[0].media)[0] == payload("sound " * 9000)
    table = pa.ipc.open_stream(rows[0].tensors).read_all()
    tensors = table["log_mel"].combine_chunks().to_numpy_ndarray()
    assert tensors.shape[1:] == SHAPE and len(tensors) > 1
    starts, ends = table["start_s"].to_pylist(), table["end_s"].to_pylist()
    assert starts[0] == 0 and ends[:-1] == starts[1:]
    assert np.array_equal(tensors.reshape(-1, MELS)[: len(Clip("sound " * 9000).mel)], Clip("sound " * 9000).mel)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (5, 8), (3, 1), (2, 3)])
def test_resampling_keeps_a_low_tone(up, down):
    t = np.arange(4000)
    y = resample(np.sin(2 * np.pi * t * 0.01), up, down)
    assert len(y) == -(-4000 * up // down)
    want = np.sin(2 * np.pi * np.arange(len(y)) * 0.01 * down / up)
    inner = slice(100, len(y) - 100)
    assert np.abs(y[inner] - want[inner]).max() < 0.02


@pytest.mark.parametrize(("up", "down"), [(1, 2), (5, 8), (3, 1), (2, 3), (8, 5)])
@pytest.mark.parametrize("n", [1, 3, 64, 999])
def test_resampling_is_filtering_between_zeros(up, down, n):
    x = np.random.default_rng(n).normal(size=n)
    h = _filter(up, down)
    wide = np.zeros(n * up)
    wide[::up] = x
    want = np.convolve(wide, h)[len(h) // 2 :][: n * up][::down]
    assert np.allclose(resample(x, up, down), want)


def test_features_follow_from_the_text(spark, make_docs):
    folder = make_docs([(d, t, "en", "s") for d, t in TEXTS])
    want = {}
    for _, t in TEXTS:
        clip = Clip(t)
        pad = np.zeros((-len(clip.mel) % SHAPE[0], MELS), dtype=np.float32)
        full = np.concatenate([clip.mel, pad])
        spans = ",".join(f"{a:.3f}-{b:.3f}" for a, b in clip.spans)
        end = len(clip.mel) * 100 / 10000
        want[hashlib.sha256(payload(t)).hexdigest()] = f"tensors={len(full) // SHAPE[0]};mel={hashlib.sha256(full.tobytes()).hexdigest()[:32]};end={end:.3f};spans={spans}"
    for x in op9_media_columns(spark, folder).collect():
        assert x.feature == want[x.payload_sha256]


def test_mel_peak_and_segments():
    rate = 8000
    mel, _ = log_mel(np.sin(2 * np.pi * 1000 * np.arange(8000) / rate), rate)
    hz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)[1:-1] / 2595) - 1)
    assert abs(hz[mel.mean(axis=0).argmax()] - 1000) < 120
    db = np.zeros(100)
    db[10:20], db[15], db[40:50] = 2, 9, 2  # only the first run reaches the high threshold
    assert segments(db, 1, 4) == [(10, 20)]


def test_empty_table(spark, make_docs):
    assert op9_media_columns(spark, make_docs([])).collect() == []

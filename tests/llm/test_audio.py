import hashlib
import zlib

import numpy as np
import pytest

from planarflow.llm import audio


def test_wav_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert audio.from_wav(audio.to_wav(data)) == data
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFX" + audio.to_wav(b"abc")[4:])


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 1), (3, 2), (2, 3), (147, 160), (1, 1), (5, 8)])
def test_polyphase_equals_spread_filter_and_decimate(up, down):
    x = np.random.default_rng(0).normal(size=777)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    taps = audio._phases(up, down)[0]
    half = len(taps) // 2
    want = np.convolve(wide, taps)[half:][: len(wide)][::down]
    got = audio.resample(x, up, down)
    assert len(got) == audio.resampled(len(x), up, down) and np.allclose(got[: len(want)], want, atol=1e-3)
    parts = [audio.resample(x, up, down, a, min(len(got), a + 100)) for a in range(0, len(got), 100)]
    assert np.allclose(np.concatenate(parts), got, atol=1e-5)


def plain_features(samples, up, down):
    """Frame by frame, with a discrete Fourier sum and loops over mel bands."""
    x = np.frombuffer(samples, np.uint8) / 128 - 1
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    taps = audio._phases(up, down)[0].astype(float)
    y = np.convolve(wide, taps)[len(taps) // 2 :][: len(wide)][::down]
    rate, mels = audio.RATE * up / down, []
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = [700 * (10 ** (top * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio.FFT // 2 + 1), np.arange(audio.WINDOW)) / audio.FFT)
    a = 0
    while not mels or a + audio.WINDOW - audio.HOP < len(y):
        frame = np.pad(y[a : a + audio.WINDOW], (0, max(0, a + audio.WINDOW - len(y))))[: audio.WINDOW]
        power = abs(turn @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WINDOW) / (audio.WINDOW - 1))))) ** 2
        row = []
        for k in range(audio.MELS):
            total = 0.0
            for j, p in enumerate(power):
                f = j * rate / audio.FFT
                total += p * max(0.0, min((f - edge[k]) / (edge[k + 1] - edge[k]), (edge[k + 2] - f) / (edge[k + 2] - edge[k + 1])))
            row.append(np.log10(total + 1e-6))
        mels.append(row)
        a += audio.HOP
    n = len(mels)
    pools = []
    for k in range(audio.FRAMES):
        low = min(int(k * n / audio.FRAMES + 1e-9), n - 1)
        high = max(int(np.ceil((k + 1) * n / audio.FRAMES - 1e-9)), low + 1)
        pools.append(np.mean(mels[low:high], axis=0))
    return np.array(pools)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3)])
def test_features_equal_plain_ones(monkeypatch, up, down):
    monkeypatch.setattr(audio, "STEP", 7)
    rng = np.random.default_rng(1)
    audio._tables.cache_clear()
    monkeypatch.setattr(audio, "UP", up), monkeypatch.setattr(audio, "DOWN", down)
    for n in (192, 960, 6720):
        samples = rng.integers(32, 127, n, dtype=np.uint8).tobytes()
        assert np.allclose(audio.features(samples, up, down)[0], plain_features(samples, up, down), atol=2e-3)
    audio._tables.cache_clear()


def test_tensors_keep_their_type(docs):
    df = audio.media_columns(docs)
    assert df.schema["tensor"].metadata["ARROW:extension:name"] == "arrow.fixed_shape_tensor"
    got = audio.as_tensors(df.toArrow())
    assert got.schema.field("tensor").type.shape == [audio.FRAMES, audio.MELS] and got.num_rows == docs.count()
    for r, tensor in zip(df.collect(), got["tensor"].combine_chunks().to_numpy_ndarray()):
        assert np.allclose(np.array(r.tensor).reshape(audio.FRAMES, audio.MELS), tensor)
        assert all(0 <= s.start < s.end for s in r.spans) and f"spans={len(r.spans)}:" in r.feature


def test_windows_change_nothing(monkeypatch):
    samples = np.random.default_rng(2).integers(32, 127, 192 * 900, dtype=np.uint8).tobytes()
    whole, spans = audio.features(samples)
    monkeypatch.setattr(audio, "STEP", 100)
    parts, again = audio.features(samples)
    assert np.allclose(whole, parts, atol=1e-3) and np.allclose(spans, again)


def test_mel_finds_a_tone():
    t = np.arange(8000) / (audio.RATE / audio.DOWN)
    low, high = (audio.log_mel(np.sin(2 * np.pi * f * t)).mean(axis=0).argmax() for f in (300, 3000))
    assert low < high


def test_hysteresis():
    level = np.array([-4, 2, 0, 0, -0.5, 2, -4, 0, -4, 4, 4.5])
    assert abs(level.mean()) < 1e-9
    assert audio.segments(level).tolist() == [[1, 6], [9, 11]]
    assert audio.segments(np.zeros(5)).tolist() == []


def test_whole_table(docs):
    rows = {}
    for r in audio.media_columns(docs, keep_media=True).collect():
        rows.setdefault(r.doc_id, r)
    for d in docs.collect():
        r, data = rows[d.doc_id], (d.text or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert audio.from_wav(bytes(r.media)) == payload and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert len(r.tensor) == audio.FRAMES * audio.MELS and all(s.start < s.end for s in r.spans)
    assert rows[2].feature == rows[3].feature


def test_tensor_type():
    column = audio.tensor_column([np.zeros((audio.FRAMES, audio.MELS), np.float32)] * 2)
    assert column.type.shape == [audio.FRAMES, audio.MELS] and len(column) == 2


def test_empty_table(no_docs):
    assert audio.media_columns(no_docs).count() == 0


def test_the_end_of_a_text_reaches_the_features():
    for n in (192, 576, 768):
        one, other = (bytes(range(97, 113)) * (n // 16 - 1) + end for end in (b"a" * 16, bytes(range(0, 256, 16))))
        (a, spans), (b, _) = audio.features(one), audio.features(other)
        assert not (a == b).all() and (spans <= n / audio.RATE).all()

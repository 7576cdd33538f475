"""Kernels against published values and plain restatements."""

import json
import math
import wave
from fractions import Fraction

import numpy as np
import pytest

from quern.kernels import audio, image, ocr
from quern.operators.cluster import dbscan, within
from quern.operators.detect import suppress
from quern.plans.audio import MelSpectrogram, WhisperFeatures
from quern.plans.image import ConfigError, ImageProcessor, Size, TileProcessor, filter_from_pil, parse_filter
from quern.sources import media


def test_sizes_follow_their_rules():
    """Random sizes against the rules in exact fractions."""
    r = np.random.default_rng(21)
    for _ in range(300):
        w, h = (int(v) for v in r.integers(30, 3000, 2))
        edge = int(r.integers(16, 700))
        long, short = max(w, h), min(w, h)
        got = Size.shortest_edge(edge).output(w, h)
        assert got[w > h] == edge and got[w <= h] == int(Fraction(edge * long, short))
        top = int(r.integers(edge, 2 * edge + 1))
        a, b = Size.shortest_edge(edge, top).output(w, h)
        assert max(a, b) <= max(top, edge) and (max(a, b) <= top or long == short)
        a, b = Size.longest_edge(edge).output(w, h)
        assert max(a, b) == edge and abs(min(a, b) - Fraction(edge * short, long)) <= 1
        low, high = 20_000, 400_000
        a, b = Size.multiple(14, low, high).output(w, h)
        assert a % 14 == b % 14 == 0 and a * b <= high and (long > 150 * short or a * b >= low or min(a, b) == 14)
    assert Size.exact(31, 17).output(900, 20) == (31, 17)


def test_filters():
    assert [filter_from_pil(i) for i in range(7)] == ["nearest", "lanczos", "bilinear", "bicubic", "box", "hamming", None]
    assert parse_filter("Cubic") == "bicubic" and parse_filter("TRIANGLE") == "bilinear" and parse_filter("x") is None


def test_center_crop_is_a_shifted_window():
    """Against a window of a copy with wide zero borders; an odd rest is one more pixel at the right or below."""
    r = np.random.default_rng(22)
    for _ in range(100):
        h, w, new_w, new_h = (int(v) for v in r.integers(1, 20, 4))
        x = r.integers(1, 256, (h, w, 3), dtype=np.uint8)
        top, left = (h - new_h) // 2, (w - new_w) // 2
        want = np.pad(x, ((40, 40), (40, 40), (0, 0)))[40 + top :, 40 + left :][:new_h, :new_w]
        assert (image.center_crop(x, new_w, new_h) == want).all()


@pytest.mark.parametrize("name", ["box", "bilinear", "hamming", "bicubic", "lanczos", "nearest"])
def test_resize_keeps_flat_images_and_identity(name):
    flat = np.full((7, 9, 3), 93, np.uint8)
    assert (image.resize(flat, 4, 13, name) == 93).all()
    x = np.random.default_rng(1).integers(0, 256, (7, 9, 3), dtype=np.uint8)
    assert image.resize(x, 9, 7, name) is x
    with pytest.raises(ValueError):
        image.resize(x, 0, 4, name)


def test_box_filter_halves_by_mean():
    x = np.array([[0, 10], [20, 31]], np.uint8)[..., None]
    assert image.resize(x, 1, 1, "box").ravel().tolist() == [16]  # rows of 5 and 26, then 15.5 upwards


def test_letterbox_geometry():
    out = image.letterbox(np.full((100, 200, 3), 9, np.uint8), 64, 64, (1, 2, 3), "bilinear")
    assert out[0, 0].tolist() == [1, 2, 3] and out[32, 32].tolist() == [9, 9, 9] and out[15, 0].tolist() == [1, 2, 3] and out[16, 0].tolist() == [9, 9, 9]


def test_tensor_orders():
    x = np.array([[[10, 20, 30]]], np.uint8)
    t = image.to_tensor(x, 1 / 255, (0.1, 0.2, 0.3), (0.5, 0.5, 0.5), "bgr", "hwc")
    want = [(np.float32(v / 255) - np.float32(m)) / np.float32(0.5) for v, m in ((30, 0.3), (20, 0.2), (10, 0.1))]
    assert np.allclose(t.ravel(), want, atol=1e-7)


def test_tile_sizes_follow_their_rules():
    r = np.random.default_rng(24)
    for _ in range(200):
        w, h = (int(v) for v in r.integers(40, 4000, 2))
        tile, longest = int(r.choice([128, 224, 364])), int(r.choice([728, 1456, 1792]))
        first, second, rows, cols = image.tile_sizes(w, h, longest, tile, True)
        assert max(first) == longest and all(v % 2 == 0 or v == longest for v in first)
        assert all(v % tile == 0 and v >= u for u, v in zip(first, second))
        assert (rows, cols) == ((second[1] // tile, second[0] // tile) if max(second) > tile else (0, 0))
    plan = TileProcessor(longest_edge=90, tile=30)
    made = list(image.tiles(np.zeros((60, 90, 3), np.uint8), plan))
    assert len(made) == 3 * 2 + 1 and made[-1][2] and not any(m[2] for m in made[:-1]) and all(m[3].shape == (3, 30, 30) for m in made)


def test_configs():
    p = ImageProcessor.from_config({"size": 224, "crop_size": {"height": 224, "width": 224}, "do_center_crop": True, "do_normalize": True, "image_mean": 0.5, "image_std": [0.5, 0.4, 0.3]})
    assert p.resize == Size.shortest_edge(224) and p.crop == (224, 224) and p.mean == (0.5, 0.5, 0.5) and p.resample == "bicubic"
    assert ImageProcessor.from_config('{"size": 99}').resize == Size.exact(99, 99)
    assert ImageProcessor.from_config({"size": {"shortest_edge": 3, "longest_edge": 9}}).resize == Size.shortest_edge(3, 9)
    assert ImageProcessor.from_config({"min_pixels": 1, "max_pixels": 9, "patch_size": 14, "merge_size": 2, "size": 3}).resize == Size.multiple(28, 1, 9)
    assert ImageProcessor.from_config({"do_resize": False}).mean is None
    with pytest.raises(ConfigError):
        ImageProcessor.from_config({"size": {"x": 1}})
    t = TileProcessor.from_config(json.dumps({"size": {"longest_edge": 2048}, "max_image_size": {"longest_edge": 512}, "resample": 1, "image_mean": [0.5] * 3, "image_std": [0.5] * 3}))
    assert (t.longest_edge, t.tile, t.resample, t.mean) == (2048, 512, "lanczos", (0.5, 0.5, 0.5))
    with pytest.raises(ConfigError):
        TileProcessor.from_config({"image_mean": 0.5})


def test_png_and_wav_round_trips(tmp_path):
    x = np.random.default_rng(2).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode_image(media.encode_png(x)) == x).all()
    assert (media.decode_image(b"P6 # c\n7 5\n255\n" + x.tobytes()) == x).all()
    with pytest.raises(media.MediaError):
        media.decode_image(b"GIF89a")
    samples = np.array([0, 0.5, -1, 0.25])
    got, rate = media.decode_wav(media.encode_wav(samples, 8000))
    assert rate == 8000 and got.tolist() == [0, 0.5, -1, 0.25]
    with wave.open(str(tmp_path / "s.wav"), "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(44100)
        f.writeframes(np.array([16384, 0, -32768, 16384], "<i2").tobytes())
    got, rate = media.decode_wav((tmp_path / "s.wav").read_bytes())
    assert rate == 44100 and got.tolist() == [0.25, -0.25]
    with pytest.raises(media.MediaError):
        media.decode_wav(b"RIFF")


def test_audio():
    assert audio.whisper_features(np.zeros(16000), WhisperFeatures(80)).shape == (80, 3000)
    assert np.allclose(audio.mel_to_hz(audio.hz_to_mel(np.array([10.0, 999, 1001, 7000]), "slaney"), "slaney"), [10, 999, 1001, 7000])
    tone = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    half = audio.resample(tone, 16000, 8000)
    assert len(half) == 8000 and np.abs(half[200:-200] - tone[::2][200:-200]).max() < 2e-3
    p = MelSpectrogram(n_fft=16, win_length=16, hop_length=4, n_mels=4)
    x = np.random.default_rng(3).standard_normal(50)
    padded = np.pad(x, 8, mode="reflect")
    n = np.arange(16)
    frame = padded[4:20] * (0.5 - 0.5 * np.cos(2 * np.pi * n / 16))
    dft = np.array([(frame * np.exp(-2j * np.pi * k * n / 16)).sum() for k in range(9)])
    assert np.allclose(audio.power_spectrogram(x, p)[1], np.abs(dft) ** 2, rtol=1e-5, atol=1e-9)
    assert audio.mel_spectrogram(np.zeros(0), p).shape == (4, 0)


def test_nms_values():
    boxes = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [20, 20, 30, 30], [0, 0, 10, 9]], np.float32)
    kept = suppress(boxes, 0.5)
    assert kept.tolist() == [0, 2]
    same = np.array([[0, 0, 10, 10], [0, 5, 10, 15]], np.float32)  # a ratio of exactly 1 / 3
    assert suppress(same, np.float32(50) / np.float32(150)).tolist() == [0, 1]
    assert suppress(np.zeros((2, 4)), 0.5).tolist() == [0, 1]  # 0 / 0 strikes nothing


def test_dbscan_values():
    x = np.array([[0, 0], [0.1, 0], [0, 0.1], [5, 5], [5.1, 5], [5, 5.1], [9, 0]])
    labels, core = dbscan(x, 0.2, 3, "euclidean")
    assert labels.tolist() == [0, 0, 0, 1, 1, 1, -1] and core.tolist() == [True] * 6 + [False]
    chain = np.array([[0.5 * i, 0] for i in range(6)])
    assert dbscan(chain, 0.5, 3, "euclidean")[0].tolist() == [0] * 6
    assert dbscan(chain, 0.5, 4, "euclidean")[0].tolist() == [-1] * 6
    pair = np.array([[0.0, 0], [3, 4]])
    assert within(pair, pair, 5.0, "euclidean").all() and not within(pair, pair, 4.999, "euclidean")[0, 1]
    assert dbscan(np.array([[1.0, 0], [5, 0], [0, 1]]), 0.01, 2, "cosine")[0].tolist() == [0, 0, -1]


def test_ring_contours():
    mask = np.ones((5, 5), bool)
    mask[2, 2] = False
    found = ocr.find_contours(mask)
    assert len(found) == 2 and found[1].tolist() == [[0, 0], [0, 4], [4, 4], [4, 0]]
    assert np.allclose(ocr.mini_box(found[1])[0], [[0, 0], [4, 0], [4, 4], [0, 4]])
    dot = np.zeros((3, 3), bool)
    dot[1, 1] = True
    assert [c.tolist() for c in ocr.find_contours(dot)] == [[[1, 1]]]
    assert ocr.find_contours(np.zeros((2, 2), bool)) == []


def test_min_area_rect_beats_every_direction():
    rng = np.random.default_rng(4)
    for _ in range(50):
        p = rng.integers(0, 100, (rng.integers(3, 20), 2)).astype(float)
        _, size = ocr.min_area_rect(p)
        best = min(np.ptp(p @ [math.cos(t), math.sin(t)]) * np.ptp(p @ [-math.sin(t), math.cos(t)]) for t in np.linspace(0, math.pi, 721))
        assert size[0] * size[1] <= best * (1 + 1e-5) + 1e-3


def test_fill_poly():
    m = np.zeros((10, 12), np.uint8)
    ocr.fill_poly(m, [(2, 3), (8, 3), (8, 7), (2, 7)])
    assert m.sum() == 7 * 5 and m[3:8, 2:9].all()
    m = np.zeros((5, 5), np.uint8)
    ocr.fill_poly(m, [(-3, -3), (20, -3), (20, 20), (-3, 20)])
    assert m.all()
    m = np.zeros((6, 6), np.uint8)
    ocr.fill_poly(m, [(0, 0), (5, 5), (0, 5)])
    assert (m == np.tril(np.ones((6, 6), np.uint8))).all()


def test_unclip_grows_rectangles():
    q = np.array([[0, 0], [10, 0], [10, 4], [0, 4]], np.float32)
    d = 40 * 1.5 / 28
    assert np.allclose(ocr.unclip(q, 1.5), [[-d, -d], [10 + d, -d], [10 + d, 4 + d], [-d, 4 + d]], atol=1e-5)


def test_db_decode_finds_a_box():
    prob = np.zeros((40, 60), np.float32)
    prob[10:20, 15:45] = 0.9
    quads, scores = ocr.db_decode(prob, 120, 80)
    assert len(quads) == 1 and scores[0] == pytest.approx(0.9, abs=1e-5)
    assert quads[0][0][0] < 30 and quads[0][2][0] > 88


def test_reading_order():
    quads = np.array([[[x, y]] * 4 for x, y in ((50, 12), (5, 15), (0, 40), (90, 10))], np.float32)
    assert ocr.reading_order(quads).tolist() == [1, 0, 3, 2]
    assert ocr.reading_order(np.zeros((0, 4, 2))).tolist() == []


def test_crops():
    x = np.random.default_rng(5).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    upright = ocr.crop_text_line(x, np.array([[5, 6], [25, 6], [25, 16], [5, 16]]))
    assert upright.shape == (10, 20, 3) and (upright == x[6:16, 5:25]).all()
    tall = ocr.crop_text_line(x, np.array([[5, 6], [10, 6], [10, 26], [5, 26]]))
    assert tall.shape == (5, 20, 3) and (tall == np.rot90(x[6:26, 5:10])).all()
    assert (ocr.cubic_table().sum((2, 3)) == 32768).all()


def test_whisper_features_of_silent_frames():
    """Frames after the last sample were transformed one by one; those that are left are as in the whole transform."""
    import time

    from quern.kernels import audio
    from quern.plans.audio import MelSpectrogram, WhisperFeatures

    rng, w = np.random.default_rng(3), WhisperFeatures(80)
    for n in (0, 1, 2, 67, 199, 200, 201, 16000, 479_000, 479_399, 479_400, 479_600, 480_000, 500_000):
        x = rng.uniform(-1, 1, n).astype(np.float32)
        m = audio.mel_spectrogram(audio.pad_or_truncate(x, w.n_samples), MelSpectrogram.whisper(80))[:, :-1]
        want = (np.maximum(m, m.max() - np.float32(8)) + np.float32(4)) / np.float32(4)
        got = audio.whisper_features(x, w)
        assert got.dtype == np.float32 and got.shape == (80, 3000) and np.abs(got - want).max() <= 1e-6
    whole, short = [], []
    for _ in range(5):
        at = time.process_time()
        audio.mel_spectrogram(np.zeros(w.n_samples, np.float32), MelSpectrogram.whisper(80))
        whole.append(time.process_time() - at)
        at = time.process_time()
        audio.whisper_features(np.ones(67, np.float32), w)
        short.append(time.process_time() - at)
    assert min(short) < min(whole) / 4

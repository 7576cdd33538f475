"""Audio kernels on float arrays."""

from __future__ import annotations

import functools
import math

import numpy as np

CROSSINGS, INSIDE = 32, 0.97


def resample(x: np.ndarray, old: int, new: int) -> np.ndarray:
    """Band-limited resampling by a Hann-windowed sinc, summed in double; edges are not made up for."""
    x = np.asarray(x, np.float32)
    if old == new or not len(x):
        return x
    ratio = new / old
    cutoff = min(ratio, 1.0) * INSIDE
    half = CROSSINGS / cutoff
    n = math.floor(len(x) * ratio + 0.5)
    at = np.arange(n) / ratio
    first, last = np.maximum(np.ceil(at - half), 0).astype(np.int64), np.minimum(np.floor(at + half), len(x) - 1).astype(np.int64)
    total = np.zeros(n)
    samples = x.astype(np.float64)
    for step in range(int((last - first).max()) + 1 if n else 0):
        k = first + step
        ok = k <= last
        d = at[ok] - k[ok]
        z = np.pi * cutoff * d
        sinc = np.divide(np.sin(z), z, out=np.ones_like(z), where=z != 0)
        total[ok] += samples[k[ok]] * (cutoff * sinc * (0.5 + 0.5 * np.cos(np.pi * d / half)))
    return total.astype(np.float32)


def pad_or_truncate(x: np.ndarray, n: int) -> np.ndarray:
    return np.pad(x[:n], (0, max(0, n - len(x))))


def hz_to_mel(f, scale: str):
    f = np.asarray(f, np.float64)
    if scale == "htk":
        return 2595.0 * np.log10(1.0 + f / 700.0)
    if scale == "kaldi":
        return 1127.0 * np.log(1.0 + f / 700.0)
    return np.where(f < 1000.0, 3.0 * f / 200.0, 15.0 + np.log(np.maximum(f, 1e-300) / 1000.0) * (27.0 / math.log(6.4)))


def mel_to_hz(m, scale: str):
    m = np.asarray(m, np.float64)
    if scale == "htk":
        return 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    if scale == "kaldi":
        return 700.0 * (np.exp(m / 1127.0) - 1.0)
    return np.where(m < 15.0, 200.0 * m / 3.0, 1000.0 * np.exp((m - 15.0) * (math.log(6.4) / 27.0)))


def linspace(a: float, b: float, n: int) -> np.ndarray:
    """n points; the last is b itself."""
    if n == 1:
        return np.array([a])
    out = np.arange(n) * ((b - a) / (n - 1)) + a
    out[-1] = b
    return out


@functools.lru_cache(32)
def filter_bank(p) -> np.ndarray:
    """(bins, mels) triangles; computed once per worker and parameters."""
    edges = mel_to_hz(linspace(float(hz_to_mel(p.f_min, p.scale)), float(hz_to_mel(p.f_max, p.scale)), p.n_mels + 2), p.scale)
    bins = linspace(0.0, float(p.sample_rate // 2), p.n_fft // 2 + 1)
    up = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    w = np.maximum(0.0, np.minimum(up, down))
    return w * (2.0 / (edges[2:] - edges[:-2])) if p.slaney_norm else w


def reflect(x: np.ndarray, pad: int) -> np.ndarray:
    """Mirror padding; where the signal is shorter than the pad, positions stop at its ends."""
    n = len(x)
    front = np.minimum(np.arange(pad, 0, -1), n - 1)
    back = np.maximum(n - 2 - np.arange(pad), 0)
    return np.concatenate([x[front], x, x[back]])


@functools.lru_cache(32)
def _window(n_fft: int, length: int) -> np.ndarray:
    out = np.zeros(n_fft)
    start = (n_fft - length) // 2
    out[start : start + length] = 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(length) / length)
    return out


def power_spectrogram(x: np.ndarray, p) -> np.ndarray:
    """(frames, bins). Real and imaginary parts pass through single precision."""
    x = np.asarray(x, np.float64)
    if not len(x):
        return np.zeros((0, p.n_fft // 2 + 1))
    if p.center:
        x = reflect(x, p.n_fft // 2)
    n = 0 if len(x) < p.n_fft else 1 + (len(x) - p.n_fft) // p.hop_length
    if not n:
        return np.zeros((0, p.n_fft // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, p.n_fft)[:: p.hop_length][:n]
    out = np.empty((n, p.n_fft // 2 + 1))
    for i in range(0, n, 512):  # bounded copies of the frames
        f = np.fft.rfft(frames[i : i + 512] * _window(p.n_fft, p.win_length))
        re, im = f.real.astype(np.float32).astype(np.float64), f.imag.astype(np.float32).astype(np.float64)
        power = re * re + im * im
        out[i : i + 512] = power if p.power == 2.0 else np.sqrt(power) ** p.power
    return out


def mel_spectrogram(x: np.ndarray, p) -> np.ndarray:
    """(mels, frames) in single precision."""
    m = np.maximum((power_spectrogram(x, p) @ filter_bank(p)).T, p.floor)
    if p.log == "ln":
        m = np.log(m)
    elif p.log == "log10":
        m = np.log10(m)
    elif p.log == "db":
        m = 10.0 * np.log10(np.maximum(m, p.db_min)) - 10.0 * math.log10(max(p.db_reference, p.db_min))
        if p.db_range is not None and m.size:
            m = np.maximum(m, m.max() - p.db_range)
    return m.astype(np.float32)


def whisper_features(x: np.ndarray, w) -> np.ndarray:
    """(mels, frames) of a clip cut or padded to the model's length. Frames after the last sample are silent, the floor in every mel,
    and are not transformed one by one."""
    from ..plans.audio import MelSpectrogram

    p = MelSpectrogram.whisper(w.n_mels)
    x = np.asarray(x, np.float32)[: w.n_samples]
    heard = -(-(len(x) + p.n_fft // 2) // p.hop_length)  # frames that reach a sample
    length = min(heard * p.hop_length + p.n_fft, w.n_samples)
    part = mel_spectrogram(pad_or_truncate(x, length), p)
    if length < w.n_samples:
        m = np.full((w.n_mels, w.n_samples // p.hop_length), np.log10(p.floor), np.float32)
        m[:, :heard] = part[:, :heard]
    else:
        m = part[:, :-1]
    return (np.maximum(m, m.max() - np.float32(8)) + np.float32(4)) / np.float32(4)

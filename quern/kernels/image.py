"""Pixel kernels on uint8 arrays of height x width x channels."""

from __future__ import annotations

import functools

import numpy as np

FIXED_BITS = 22
SUPPORT = {"box": 0.5, "bilinear": 1.0, "hamming": 1.0, "bicubic": 2.0, "lanczos": 3.0}


def filter_values(name: str, x: np.ndarray) -> np.ndarray:
    """The resampling kernel at distances x."""
    a = np.abs(x)
    if name == "box":
        return ((x > -0.5) & (x <= 0.5)).astype(np.float64)
    if name == "bilinear":
        return np.maximum(1.0 - a, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if name == "hamming":
            t = np.pi * a
            y = np.sin(t) / t * (float(np.float32(0.54)) + float(np.float32(0.46)) * np.cos(t))
            return np.where(a == 0, 1.0, np.where(a >= 1, 0.0, y))
        if name == "bicubic":
            near = ((-0.5 + 2) * a - (-0.5 + 3)) * a * a + 1
            far = (((a - 5) * a + 8) * a - 4) * -0.5
            return np.where(a < 1, near, np.where(a < 2, far, 0.0))
        sinc = lambda v: np.where(v == 0, 1.0, np.sin(np.pi * v) / (np.pi * v))
        return np.where((x >= -3) & (x < 3), sinc(x) * sinc(x / 3), 0.0)


@functools.lru_cache(256)
def axis_weights(size: int, out: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(first, weights): for each output position the first input position and its fixed-point weights (padded with zeros)."""
    ratio = size / out
    widen = max(ratio, 1.0)
    reach = SUPPORT[name] * widen
    center = (np.arange(out) + 0.5) * ratio
    first = np.maximum(np.trunc(center - reach + 0.5), 0).astype(np.int64)
    end = np.minimum(np.trunc(center + reach + 0.5), size).astype(np.int64)
    taps = np.arange(int((end - first).max()))
    inside = taps[None, :] < (end - first)[:, None]
    w = np.where(inside, filter_values(name, (taps[None, :] + first[:, None] - center[:, None] + 0.5) * (1.0 / widen)), 0.0)
    total = np.zeros(out)
    for t in taps:  # in order, as sums in double depend on it
        total = total + w[:, t]
    w = np.divide(w, total[:, None], out=w.copy(), where=total[:, None] != 0)
    scaled = w * (1 << FIXED_BITS)
    return first, np.trunc(scaled + np.where(scaled < 0, -0.5, 0.5)).astype(np.int64)


def _along_rows(x: np.ndarray, out: int, name: str) -> np.ndarray:
    """Resample the first axis."""
    first, weights = axis_weights(x.shape[0], out, name)
    at = np.minimum(first[:, None] + np.arange(weights.shape[1]), x.shape[0] - 1)
    total = np.full((out, *x.shape[1:]), 1 << (FIXED_BITS - 1), np.int64)
    for t in range(weights.shape[1]):
        total += x[at[:, t]].astype(np.int64) * weights[:, t].reshape(-1, *[1] * (x.ndim - 1))
    return np.clip(total >> FIXED_BITS, 0, 255).astype(np.uint8)


def nearest_positions(size: int, out: int) -> np.ndarray:
    """Source positions; the step is accumulated, not multiplied."""
    step = size / out
    return np.minimum(np.add.accumulate(np.concatenate(([step / 2], np.full(out - 1, step)))).astype(np.int64), size - 1)


def resize(x: np.ndarray, width: int, height: int, name: str) -> np.ndarray:
    """Resize in two passes, columns then rows, with an 8-bit result between them; an axis that keeps its size is left alone."""
    if width < 1 or height < 1:
        raise ValueError(f"cannot resize to {width} x {height}")
    h, w = x.shape[:2]
    if (w, h) == (width, height):
        return x
    if name == "nearest":
        return x[nearest_positions(h, height)][:, nearest_positions(w, width)]
    if w != width:
        x = _along_rows(x.transpose(1, 0, *range(2, x.ndim)), width, name).transpose(1, 0, *range(2, x.ndim))
    return _along_rows(x, height, name) if h != height else x


@functools.lru_cache(256)
def linear_weights(size: int, out: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first, two weights, bits) of bilinear interpolation without antialiasing."""
    real = np.maximum(size / out * (np.arange(out) + 0.5) - 0.5, 0.0)
    first = np.minimum(np.floor(real).astype(np.int64), size - 1)
    part = real - first
    w = np.column_stack([1.0 - part, part])
    edge = first + 1 >= size
    w[edge] = np.column_stack([w[edge].sum(1), np.zeros(edge.sum())])
    bits = 0
    while bits < 22 and int(0.5 + w.max() * (1 << (bits + 1))) < 1 << 15:
        bits += 1
    return first, np.trunc(0.5 + w * (1 << bits)).astype(np.int64), bits


def resize_bilinear_no_antialias(x: np.ndarray, width: int, height: int) -> np.ndarray:
    def rows(v, out):
        first, w, bits = linear_weights(v.shape[0], out)
        second = np.minimum(first + 1, v.shape[0] - 1)
        shape = (-1, *[1] * (v.ndim - 1))
        total = v[first].astype(np.int64) * w[:, 0].reshape(shape) + v[second].astype(np.int64) * w[:, 1].reshape(shape) + (1 << (bits - 1))
        return np.clip(total >> bits, 0, 255).astype(np.uint8)

    if x.shape[1] != width:
        x = rows(x.transpose(1, 0, *range(2, x.ndim)), width).transpose(1, 0, *range(2, x.ndim))
    return rows(x, height) if x.shape[0] != height else x


def center_crop(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """The middle, with zeros outside the image; offsets are floored."""
    h, w = x.shape[:2]
    out = np.zeros((height, width, *x.shape[2:]), x.dtype)
    top, left = (h - height) // 2, (w - width) // 2
    ys, xs = slice(max(top, 0), min(top + height, h)), slice(max(left, 0), min(left + width, w))
    part = x[ys, xs]
    out[ys.start - top : ys.start - top + part.shape[0], xs.start - left : xs.start - left + part.shape[1]] = part
    return out


def letterbox(x: np.ndarray, width: int, height: int, fill: tuple[int, int, int], name: str) -> np.ndarray:
    h, w = x.shape[:2]
    r = min(width / w, height / h)
    iw, ih = (int(min(max(round(v * r), 1), t)) for v, t in ((w, width), (h, height)))
    left, top = max(round((width - iw) / 2 - 0.1), 0), max(round((height - ih) / 2 - 0.1), 0)
    out = np.empty((height, width, 3), np.uint8)
    out[:] = fill
    inner = resize(x, iw, ih, name)[: height - top, : width - left]
    out[top : top + inner.shape[0], left : left + inner.shape[1]] = inner
    return out


def to_tensor(x: np.ndarray, rescale: float | None, mean, std, order: str = "rgb", layout: str = "chw") -> np.ndarray:
    """Scaled in double and kept in single precision, normalised in single precision, by a table of the 256 values per channel.
    Means go with the channels of RGB, whatever the order of the output."""
    values = np.arange(256, dtype=np.float64)
    table = np.repeat((values * rescale if rescale is not None else values).astype(np.float32)[None], 3, 0)
    if mean is not None and std is not None:
        table = (table - np.array(mean, np.float32)[:, None]) / np.array(std, np.float32)[:, None]
    planes = [table[c][x[..., c]] for c in range(3)]
    if order == "bgr":
        planes.reverse()
    return np.stack(planes, 0 if layout == "chw" else -1)


def to_rgb(x: np.ndarray) -> np.ndarray:
    """Gray repeated, alpha dropped."""
    if x.ndim == 2:
        x = x[..., None]
    if x.shape[2] < 3:
        return np.repeat(x[..., :1], 3, 2)
    return np.ascontiguousarray(x[..., :3])


def prepare(x: np.ndarray, p) -> np.ndarray:
    x = to_rgb(x)
    if p.resize is not None:
        x = resize(x, *p.resize.output(x.shape[1], x.shape[0]), p.resample)
    return center_crop(x, *p.crop) if p.crop is not None else x


def process(x: np.ndarray, p) -> np.ndarray:
    return to_tensor(prepare(x, p), p.rescale, p.mean, p.std, p.order, p.layout)


def tile_sizes(w: int, h: int, longest: int, tile: int, splitting: bool) -> tuple[tuple[int, int], tuple[int, int], int, int]:
    """(scaled, padded, rows, cols); see functions.geometry.tile_plan."""
    aspect = w / h
    if w >= h:
        sw, sh = longest, int(longest / aspect)
        sh += sh % 2
    else:
        sw, sh = int(longest * aspect), longest
        sw += sw % 2
    sw, sh = max(sw, 1), max(sh, 1)
    aspect = sw / sh
    if max(sw, sh) > 4096:
        sw, sh = (4096, max(int(4096 / aspect), 1)) if sw >= sh else (max(int(4096 * aspect), 1), 4096)
    if not splitting:
        return (sw, sh), (tile, tile), 0, 0
    up = lambda v: -(-v // tile) * tile
    aspect = sw / sh
    pw, ph = (up(sw), up(int(up(sw) / aspect))) if sw >= sh else (up(int(up(sh) * aspect)), up(sh))
    split = pw > tile or ph > tile
    return (sw, sh), (pw, ph), ph // tile if split else 0, pw // tile if split else 0


def tiles(x: np.ndarray, p):
    """(row, col, is_global, tensor) of each tile, row by row, the view of the whole image last."""
    x = to_rgb(x)
    scaled, padded, rows, cols = tile_sizes(x.shape[1], x.shape[0], p.longest_edge, p.tile, p.splitting)
    x = resize(resize(x, *scaled, p.resample), *padded, p.resample)
    tensor = lambda v: to_tensor(v, p.rescale, p.mean, p.std)
    if not rows:
        yield 0, 0, False, tensor(x)
        return
    t = p.tile
    for r in range(rows):
        for c in range(cols):
            yield r, c, False, tensor(x[r * t : (r + 1) * t, c * t : (c + 1) * t])
    yield rows, cols, True, tensor(resize(x, t, t, p.resample))

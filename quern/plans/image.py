"""Parameters of image preprocessing, and readers of preprocessor configurations."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

FILTERS = ("nearest", "box", "bilinear", "hamming", "bicubic", "lanczos")
#: Numbers by which image libraries' configurations name resampling filters (fixed values).
PIL_FILTERS = {0: "nearest", 1: "lanczos", 2: "bilinear", 3: "bicubic", 4: "box", 5: "hamming"}
_ALIASES = {"linear": "bilinear", "triangle": "bilinear", "cubic": "bicubic", "lanczos3": "lanczos"}


class ConfigError(ValueError):
    """A configuration that cannot be followed."""


def filter_from_pil(number: int) -> str | None:
    return PIL_FILTERS.get(number)


def parse_filter(name: str) -> str | None:
    """The filter of a name, in any case, None if there is none."""
    low = name.lower()
    low = _ALIASES.get(low, low)
    return low if low in FILTERS else None


@dataclass(frozen=True)
class Size:
    """kind: exact (width, height), shortest (edge, cap), longest (edge) or multiple (factor, min_pixels, max_pixels)."""

    kind: str
    values: tuple

    @classmethod
    def exact(cls, width: int, height: int) -> "Size":
        return cls("exact", (width, height))

    @classmethod
    def shortest_edge(cls, edge: int, max_longest: int | None = None) -> "Size":
        return cls("shortest", (edge, max_longest))

    @classmethod
    def longest_edge(cls, edge: int) -> "Size":
        return cls("longest", (edge,))

    @classmethod
    def multiple(cls, factor: int, min_pixels: int, max_pixels: int) -> "Size":
        return cls("multiple", (factor, min_pixels, max_pixels))

    def column(self, w, h):
        """The output size as a struct column."""
        from ..functions import geometry as g

        if self.kind == "exact":
            return g.exact(*self.values)
        make = {"shortest": g.shortest_edge, "longest": g.longest_edge, "multiple": g.multiple}[self.kind]
        return make(w, h, *self.values)

    def output(self, w: int, h: int) -> tuple[int, int]:
        """The output size of one image, for kernels."""
        if self.kind == "exact":
            return self.values
        if self.kind == "shortest":
            edge, cap = self.values
            short, long = min(w, h), max(w, h)
            s, g = edge, int(edge * long / short)
            if cap is not None and g > cap:
                s, g = int(cap * s / g), cap
            return (s, g) if w <= h else (g, s)
        if self.kind == "longest":
            k = self.values[0] / max(w, h)
            return int(w * k + 0.5), int(h * k + 0.5)
        f, low, high = self.values
        rw, rh = f * round(w / f), f * round(h / f)
        if rw * rh > high:
            b = math.sqrt(h * w / high)
            return max(f, f * math.floor(w / b / f)), max(f, f * math.floor(h / b / f))
        if rw * rh < low:
            b = math.sqrt(low / (h * w))
            return f * math.ceil(w * b / f), f * math.ceil(h * b / f)
        return rw, rh


@dataclass(frozen=True)
class ImageProcessor:
    resize: Size | None = None
    resample: str = "bicubic"
    crop: tuple[int, int] | None = None  # width, height
    rescale: float | None = 1 / 255
    mean: tuple[float, ...] | None = None
    std: tuple[float, ...] | None = None
    order: str = "rgb"
    layout: str = "chw"

    @classmethod
    def from_config(cls, config: str | dict) -> "ImageProcessor":
        """From a `preprocessor_config.json`. Pixel bounds with a patch size come before `size`; in `size`, a number is the shorter
        edge if `crop_size` is there and a square if not; height and width come before shortest_edge, before longest_edge."""
        c = json.loads(config) if isinstance(config, str) else config
        resize = _size(c) if c.get("do_resize", True) else None
        crop = None
        if c.get("do_center_crop", False):
            x = c.get("crop_size")
            crop = (x, x) if isinstance(x, int) else (x["width"], x["height"]) if isinstance(x, dict) and {"width", "height"} <= x.keys() else _fail("crop_size")
        mean = std = None
        if c.get("do_normalize", False):
            mean, std = (_three(c, k, True) for k in ("image_mean", "image_std"))
        return cls(resize, _filter(c, 3), crop, float(c.get("rescale_factor", 1 / 255)) if c.get("do_rescale", True) else None, mean, std)


def _fail(name: str):
    raise ConfigError(f"{name} is missing or not understood")


def _filter(c: dict, default: int) -> str:
    return filter_from_pil(c.get("resample", default)) or _fail("resample")


def _three(c: dict, name: str, scalars: bool) -> tuple[float, ...]:
    x = c.get(name)
    if scalars and isinstance(x, (int, float)):
        return (float(x),) * 3
    if not isinstance(x, list) or len(x) != 3:
        _fail(name)
    return tuple(float(v) for v in x)


def _size(c: dict) -> Size:
    if all(k in c for k in ("min_pixels", "max_pixels", "patch_size")):
        return Size.multiple(c["patch_size"] * c.get("merge_size", 1), c["min_pixels"], c["max_pixels"])
    s = c.get("size")
    if isinstance(s, int):
        return Size.shortest_edge(s) if c.get("crop_size") is not None else Size.exact(s, s)
    if not isinstance(s, dict):
        _fail("size")
    if "height" in s and "width" in s:
        return Size.exact(s["width"], s["height"])
    if "shortest_edge" in s:
        return Size.shortest_edge(s["shortest_edge"], s.get("longest_edge"))
    if "longest_edge" in s:
        return Size.longest_edge(s["longest_edge"])
    return _fail("size")


@dataclass(frozen=True)
class TileProcessor:
    longest_edge: int = 4 * 364
    tile: int = 364
    resample: str = "lanczos"
    splitting: bool = True
    rescale: float | None = 1 / 255
    mean: tuple[float, ...] | None = field(default=(0.5, 0.5, 0.5))
    std: tuple[float, ...] | None = field(default=(0.5, 0.5, 0.5))

    @classmethod
    def from_config(cls, config: str | dict) -> "TileProcessor":
        """From a configuration with `size.longest_edge` and `max_image_size.longest_edge`; normalization is on unless turned off,
        and means must be lists."""
        c = json.loads(config) if isinstance(config, str) else config
        tile = (c.get("max_image_size") or {}).get("longest_edge", 364)
        mean = std = None
        if c.get("do_normalize", True):
            mean, std = (_three(c, k, False) if k in c else (0.5, 0.5, 0.5) for k in ("image_mean", "image_std"))
        return cls(
            (c.get("size") or {}).get("longest_edge", 4 * 364), tile, _filter(c, 1), c.get("do_image_splitting", True),
            float(c.get("rescale_factor", 1 / 255)) if c.get("do_rescale", True) else None, mean, std,
        )

"""Sizes of images, letterboxes and tiles, as expressions over width and height columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def half_even(x) -> Column:
    """Rounding to the nearest integer, ties to even, as a double."""
    return F.rint(_d(x))


def trunc(x: Column) -> Column:
    return x.cast("long").cast("double")


def _ints(w: Column, h: Column) -> Column:
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def exact(width: int, height: int) -> Column:
    return _ints(F.lit(width), F.lit(height))


def shortest_edge(w, h, edge: int, max_longest: int | None = None) -> Column:
    """The shorter side becomes edge, the longer follows truncated; a cap on the longer one shrinks both again."""
    w, h = _d(w), _d(h)
    short, long = F.least(w, h), F.greatest(w, h)
    s, g = F.lit(float(edge)), trunc(F.lit(float(edge)) * long / short)
    if max_longest is not None:
        cap = F.lit(float(max_longest))
        s, g = F.when(g > cap, trunc(cap * s / g)).otherwise(s), F.least(g, cap)
    return F.when(w <= h, _ints(s, g)).otherwise(_ints(g, s))


def longest_edge(w, h, edge: int) -> Column:
    w, h = _d(w), _d(h)
    k = F.lit(float(edge)) / F.greatest(w, h)
    return _ints(trunc(w * k + 0.5), trunc(h * k + 0.5))


def multiple(w, h, factor: int, min_pixels: int, max_pixels: int) -> Column:
    """Both sides a multiple of factor, the area within bounds."""
    w, h, f = _d(w), _d(h), F.lit(float(factor))
    rw, rh = f * F.rint(w / f), f * F.rint(h / f)
    down = F.sqrt(h * w / float(max_pixels))
    up = F.sqrt(F.lit(float(min_pixels)) / (h * w))
    fit = lambda v: F.greatest(f, f * F.floor(v / down / f).cast("double"))
    grow = lambda v: f * F.ceil(v * up / f).cast("double")
    area = rw * rh
    return F.when(area > max_pixels, _ints(fit(w), fit(h))).when(area < min_pixels, _ints(grow(w), grow(h))).otherwise(_ints(rw, rh))


def letterbox(w, h, width: int, height: int) -> Column:
    """struct(width, height, left, top): the inner size and its offset in a width x height frame."""
    w, h = _d(w), _d(h)
    tw, th = F.lit(float(width)), F.lit(float(height))
    r = F.least(tw / w, th / h)
    iw = F.least(F.greatest(F.rint(w * r), F.lit(1.0)), tw)
    ih = F.least(F.greatest(F.rint(h * r), F.lit(1.0)), th)
    pad = lambda t, i: F.greatest(F.rint((t - i) / 2 - 0.1), F.lit(0.0)).cast("int")
    return F.struct(iw.cast("int").alias("width"), ih.cast("int").alias("height"), pad(tw, iw).alias("left"), pad(th, ih).alias("top"))


def rescale_to_max(w, h, longest: int) -> Column:
    """Longer side `longest`, the other by aspect, truncated, made even upwards, at least 1."""
    w, h = _d(w), _d(h)
    aspect = w / h
    even = lambda v: v + (v % 2)
    top = F.lit(float(longest))
    other_h, other_w = trunc(top / aspect), trunc(top * aspect)
    wide = w >= h
    ow = F.when(wide, top).otherwise(even(other_w))
    oh = F.when(wide, even(other_h)).otherwise(top)
    return _ints(F.greatest(ow, F.lit(1.0)), F.greatest(oh, F.lit(1.0)))


def below_bound(w, h, bound: int = 4096) -> Column:
    """The longer side at most `bound`, the other by aspect, truncated, at least 1."""
    w, h = _d(w), _d(h)
    aspect, top = w / h, F.lit(float(bound))
    wide = w >= h
    ow = F.when(wide & (w > top), top).when(~wide & (h > top), trunc(top * aspect)).otherwise(w)
    oh = F.when(wide & (w > top), trunc(top / aspect)).when(~wide & (h > top), top).otherwise(h)
    return _ints(F.greatest(ow, F.lit(1.0)), F.greatest(oh, F.lit(1.0)))


def size_for_tiles(w, h, tile: int) -> Column:
    """Both sides rounded up to tiles, the longer one first, the other from the rounded longer one."""
    w, h, t = _d(w), _d(h), F.lit(float(tile))
    aspect = w / h
    up = lambda v: F.ceil(v / t).cast("double") * t
    return F.when(w >= h, _ints(up(w), up(trunc(up(w) / aspect)))).otherwise(_ints(up(trunc(up(h) * aspect)), up(h)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; nested expressions would be written out again at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tile_plan(w, h, longest: int, tile: int, splitting: bool = True) -> Column:
    """struct(scaled, padded, rows, cols): the sizes on the way to tiles, and the grid (0 x 0 if the image is one tile)."""

    def grid(scaled: Column, padded: Column) -> Column:
        split = F.lit(splitting) & ((padded["width"] > tile) | (padded["height"] > tile))
        count = lambda v: F.when(split, (v / tile).cast("int")).otherwise(0)
        return F.struct(scaled.alias("scaled"), padded.alias("padded"), count(padded["height"]).alias("rows"), count(padded["width"]).alias("cols"))

    def pad(scaled: Column) -> Column:
        padded = size_for_tiles(scaled["width"], scaled["height"], tile) if splitting else exact(tile, tile)
        return let(padded, lambda p: grid(scaled, p))

    return let(rescale_to_max(w, h, longest), lambda f: let(below_bound(f["width"], f["height"]), pad))


def has_global(rows, cols) -> Column:
    return (F.col(rows) > 0) & (F.col(cols) > 0)

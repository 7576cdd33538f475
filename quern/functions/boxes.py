"""Box algebra on float columns. Single precision is kept by casting after each step, as Spark divides in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("xyxy", "xywh", "cxcywh")


def parse_format(name: str) -> str | None:
    """The box format of a name (case-sensitive), None if there is none."""
    return name if name in FORMATS else None


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def convert(box: tuple, source: str, target: str) -> tuple[Column, Column, Column, Column]:
    """Four columns from one format to another, by way of corners."""
    for name in (source, target):
        if parse_format(name) is None:
            raise ValueError(f"unknown box format {name!r}")
    a, b, c, d = (f32(F.col(x) if isinstance(x, str) else x) for x in box)
    if source == target:
        return a, b, c, d
    half = f32(0.5)
    if source == "xywh":
        a, b, c, d = a, b, f32(a + c), f32(b + d)
    elif source == "cxcywh":
        w, h = f32(c * half), f32(d * half)
        a, b, c, d = f32(a - w), f32(b - h), f32(a + w), f32(b + h)
    if target == "xyxy":
        return a, b, c, d
    w, h = f32(c - a), f32(d - b)
    if target == "xywh":
        return a, b, w, h
    return f32(f32(a + c) * half), f32(f32(b + d) * half), w, h


def area(box: tuple) -> Column:
    x1, y1, x2, y2 = (f32(F.col(x) if isinstance(x, str) else x) for x in box)
    return f32(f32(x2 - x1) * f32(y2 - y1))


def intersection(a: tuple, b: tuple) -> Column:
    """Area of the common part, 0 if there is none."""
    ax1, ay1, ax2, ay2 = (f32(F.col(x) if isinstance(x, str) else x) for x in a)
    bx1, by1, bx2, by2 = (f32(F.col(x) if isinstance(x, str) else x) for x in b)
    w = F.greatest(f32(F.least(ax2, bx2) - F.greatest(ax1, bx1)), f32(0.0))
    h = F.greatest(f32(F.least(ay2, by2) - F.greatest(ay1, by1)), f32(0.0))
    return f32(w * h)


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; NaN where the union is zero."""
    i = intersection(a, b)
    union = f32(f32(area(a) + area(b)) - i)
    return F.when(union == f32(0.0), F.when(i == f32(0.0), f32(float("nan"))).otherwise(f32(float("inf")))).otherwise(f32(i / F.when(union != f32(0.0), union)))


def clip(box: tuple, width: float, height: float) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = (f32(F.col(x) if isinstance(x, str) else x) for x in box)
    keep = lambda v, top: F.least(F.greatest(v, f32(0.0)), f32(top))
    return keep(x1, width), keep(y1, height), keep(x2, width), keep(y2, height)


def scale(box: tuple, sx: float, sy: float) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = (f32(F.col(x) if isinstance(x, str) else x) for x in box)
    return f32(x1 * f32(sx)), f32(y1 * f32(sy)), f32(x2 * f32(sx)), f32(y2 * f32(sy))


def unletterbox(box: tuple, model: tuple[Column, Column], original: tuple[Column, Column]) -> tuple[Column, Column, Column, Column]:
    """Boxes on a letterboxed model input, back on the original image, clipped to it. Sizes are (width, height)."""
    mw, mh = (x.cast("double") for x in model)
    ow, oh = (x.cast("double") for x in original)
    gain = F.least(mw / ow, mh / oh)
    left, top = F.rint((mw - ow * gain) / 2 - 0.1), F.rint((mh - oh * gain) / 2 - 0.1)
    x1, y1, x2, y2 = (f32(F.col(x) if isinstance(x, str) else x).cast("double") for x in box)
    moved = (f32((x1 - left) / gain), f32((y1 - top) / gain), f32((x2 - left) / gain), f32((y2 - top) / gain))
    keep = lambda v, m: F.least(F.greatest(v, f32(0.0)), f32(m))
    return keep(moved[0], ow), keep(moved[1], oh), keep(moved[2], ow), keep(moved[3], oh)

"""Text boxes from probability maps, reading order, and line crops, over tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import f32
from ..functions.geometry import let
from ..kernels import ocr as k
from ..session import prepare
from .image import IMAGE_DDL, _PIXELS, pack, slices

QUAD_DDL = "array<struct<x:float,y:float>>"
_QUAD = pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32())]))


def _points(q: np.ndarray) -> list[dict]:
    return [{"x": x, "y": y} for x, y in np.asarray(q, np.float64).tolist()]


def _array(points: list[dict]) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], np.float32).reshape(-1, 2)


def order_corners(quad: Column) -> Column:
    """Top left, top right, bottom right, bottom left."""
    p = F.array_sort(F.transform(quad, lambda v, i: F.struct(v["x"].alias("x"), i.alias("i"), v["y"].alias("y"))))
    at = lambda i: F.get(p, F.lit(i))
    left, right = at(1)["y"] > at(0)["y"], at(3)["y"] > at(2)["y"]
    four = F.array(F.when(left, at(0)).otherwise(at(1)), F.when(right, at(2)).otherwise(at(3)), F.when(right, at(3)).otherwise(at(2)), F.when(left, at(1)).otherwise(at(0)))
    return F.transform(four, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))


def unclip(quad: Column, ratio: float) -> Column:
    """A quad's edges moved outwards by area * ratio / perimeter; corners are where moved neighbours meet."""
    four = F.sequence(F.lit(0), F.lit(3))
    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda s, v: s + f(v))

    def edges(p):
        def edge(i):
            a, b = F.get(p, i), F.get(p, (i + 1) % 4)
            ex, ey = b["x"] - a["x"], b["y"] - a["y"]
            return F.struct(a["x"].alias("x"), a["y"].alias("y"), ex.alias("ex"), ey.alias("ey"), F.sqrt(ex * ex + ey * ey).alias("len"), (a["x"] * b["y"] - b["x"] * a["y"]).alias("turn"))

        return F.transform(four, edge)

    def moved(e):
        around, turn = total(e, lambda v: v["len"]), total(e, lambda v: v["turn"])
        away = F.when(around > 0, F.abs(turn) / 2 * float(np.float32(ratio)) / F.when(around > 0, around)).otherwise(F.lit(0.0))
        whole = F.struct(away.alias("away"), F.when(turn > 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"))

        def shift(w):
            def one(v):
                n = F.greatest(v["len"], F.lit(1e-6))
                d = F.struct((v["ex"] / n).alias("x"), (v["ey"] / n).alias("y"))
                return let(d, lambda u: F.struct(
                    v["x"].alias("x"), v["y"].alias("y"), u["x"].alias("dx"), u["y"].alias("dy"), (u["y"] * w["sign"]).alias("ox"), (-u["x"] * w["sign"]).alias("oy"), w["away"].alias("away"),
                    (v["x"] + w["away"] * (u["y"] * w["sign"])).alias("mx"), (v["y"] + w["away"] * (-u["x"] * w["sign"])).alias("my"),
                ))

            return F.transform(e, one)

        return let(whole, shift)

    def corners(m):
        def corner(i):
            def meet(v):
                a, b = v["a"], v["b"]  # the edge before, and the edge at the corner
                cross = a["dx"] * b["dy"] - a["dy"] * b["dx"]

                def place(c):
                    flat = F.abs(c) < 1e-6
                    t = ((b["mx"] - a["mx"]) * b["dy"] - (b["my"] - a["my"]) * b["dx"]) / F.when(flat, F.lit(1.0)).otherwise(c)
                    at = lambda p, o, s, d: F.when(flat, b[p] + 0.5 * b["away"] * (a[o] + b[o])).otherwise(a[s] + a[d] * t)
                    return F.struct(f32(at("x", "ox", "mx", "dx")).alias("x"), f32(at("y", "oy", "my", "dy")).alias("y"))

                return let(cross, place)

            return let(F.struct(F.get(m, (i + 3) % 4).alias("a"), F.get(m, i).alias("b")), meet)

        return F.transform(four, corner)

    points = F.transform(quad, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y")))
    return let(let(let(points, edges), moved), corners)


def _rows(df: DataFrame, source: str, fields: str, kinds: list[tuple[str, pa.DataType]], f) -> DataFrame:
    """Every row with the rows that f makes of its source column."""
    prepare(df.sparkSession)
    kept = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in df.schema if x.name != source)

    def run(batches):
        for b in slices(batches):  # values become Python objects, of many times their size
            at = b.schema.get_field_index(source)
            rest = [i for i in range(b.num_columns) if i != at]
            made, origin = [], []
            for i, v in enumerate(b.column(at).to_pylist()):
                if v is not None:
                    new = f(v)
                    made += new
                    origin += [i] * len(new)
            take = pa.array(origin, pa.int64())
            cols = [pa.array([m[j] for m in made], t) for j, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in rest), *cols], [*(b.schema.names[i] for i in rest), *(n for n, _ in kinds)])

    return df.mapInArrow(run, kept + fields)


def _map(v: dict) -> np.ndarray:
    return np.array(v["data"], np.float32).reshape(v["h"], v["w"])


def find_contours(df: DataFrame, mask: str = "mask") -> DataFrame:
    """(idx, points) per border of masks struct<h, w, data>, where data above 0 is foreground."""
    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
    one = lambda v: [(i, [{"x": x, "y": y} for x, y in c.tolist()]) for i, c in enumerate(k.find_contours(_map(v) > 0))]
    return _rows(df, mask, "idx int, points array<struct<x:int,y:int>>", [("idx", pa.int32()), ("points", kind)], one)


def min_area_rect(df: DataFrame, points: str = "points") -> DataFrame:
    """(corners, width, height) of each array of points; corners as order_corners."""

    def one(v):
        c, s = k.min_area_rect(_array(v))
        return [(_points(k.order_corners(c)), float(s[0]), float(s[1]))]

    return _rows(df, points, f"corners {QUAD_DDL}, width float, height float", [("corners", _QUAD), ("width", pa.float32()), ("height", pa.float32())], one)


def db_decode(df: DataFrame, plan: k.DbDecoder = k.DbDecoder(), prob: str = "prob", width: str = "width", height: str = "height") -> DataFrame:
    """(idx, quad, score) per text box of probability maps struct<h, w, data>, on the original image."""
    source = df.withColumn("_in", F.struct(F.col(prob).alias("map"), F.col(width).alias("w"), F.col(height).alias("h"))).drop(prob)

    def one(v):
        quads, scores = k.db_decode(_map(v["map"]), v["w"], v["h"], plan)
        return [(i, _points(q), float(s)) for i, (q, s) in enumerate(zip(quads, scores))]

    return _rows(source, "_in", f"idx int, quad {QUAD_DDL}, score float", [("idx", pa.int32()), ("quad", _QUAD), ("score", pa.float32())], one)


def box_score(df: DataFrame, prob: str = "prob", quad: str = "quad") -> DataFrame:
    source = df.withColumn("_in", F.struct(F.col(prob).alias("map"), F.col(quad).alias("quad"))).drop(prob)
    return _rows(source, "_in", "box_score float", [("box_score", pa.float32())], lambda v: [(k.box_score(_map(v["map"]), _array(v["quad"])),)])


def _numbered(df: DataFrame, source: str, f) -> DataFrame:
    """Every row with `_k` and `_p`, the positions and values of the array of whole numbers that f makes of its source column. The
    array is what is sent; its rows are made in the JVM."""
    done = _rows(df, source, "_a array<int>", [("_a", pa.list_(pa.int32()))], lambda v: [(f(v).astype(np.int32),)])
    return done.select(*[c for c in df.columns if c != source], F.posexplode("_a").alias("_k", "_p"))


def fill_poly(df: DataFrame, width: int, height: int, points: str = "points") -> DataFrame:
    """The filled pixels (y, x) of each polygon of integer points in a width x height image."""

    def one(v):
        y = [int(p["y"]) for p in v]
        top, bottom = (min(max(f(y, default=0), 0), height - 1) for f in (min, max))
        m = np.zeros((height, width), np.uint8)
        k.fill_poly(m, [(p["x"], p["y"]) for p in v])
        return np.flatnonzero(m[top : bottom + 1]) + top * width

    done = _numbered(df, points, one)
    return done.select(*[c for c in df.columns if c != points], F.expr(f"int(_p div {width})").alias("y"), (F.col("_p") % width).alias("x"))


def line_pixels(df: DataFrame, width: int, height: int, ends: str = "ends") -> DataFrame:
    """(k, x, y): the pixels of each line between two integer points, in drawing order, cut to a width x height image."""

    def one(v):
        x, y = k.line_pixels(width, height, *((p["x"], p["y"]) for p in v))
        return y * width + x

    done = _numbered(df, ends, one)
    return done.select(*[c for c in df.columns if c != ends], F.col("_k").alias("k"), (F.col("_p") % width).alias("x"), F.expr(f"int(_p div {width})").alias("y"))


def reading_order(boxes: DataFrame, group: list[str], quad: str = "quad", idx: str = "idx") -> DataFrame:
    """(group, idx, rank): reading order per image. The tolerance between lines is not transitive, so no sort gives it; an image's boxes
    meet in one array."""
    lists = boxes.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(quad).alias("q")))).alias("_b"))

    def one(v):
        order = k.reading_order(np.array([_array(b["q"]) for b in v]))
        return [(v[j]["i"], r) for r, j in enumerate(order.tolist())]

    return _rows(lists, "_b", f"`{idx}` long, rank int", [(idx, pa.int64()), ("rank", pa.int32())], one)


def crop_text_lines(df: DataFrame, image: str = "image", quad: str = "quad") -> DataFrame:
    """Each row's text line, upright, as an image."""
    source = df.withColumn("_in", F.struct(F.col(image).alias("image"), F.col(quad).alias("quad"))).drop(image)

    def one(v):
        i = v["image"]
        return [(pack(k.crop_text_line(np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], -1), _array(v["quad"]))),)]

    return _rows(source, "_in", f"line {IMAGE_DDL}", [("line", _PIXELS)], one)

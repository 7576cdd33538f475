"""Image preprocessing over tables. Images are struct<width, height, data> of interleaved RGB, or rows (img_id, y, x, c, v)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import image as k
from ..plans.image import ImageProcessor, TileProcessor
from ..session import prepare


def _image(v: dict) -> np.ndarray:
    return np.frombuffer(v["data"], np.uint8).reshape(v["height"], v["width"], -1)


def _schema(df: DataFrame, skip: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != skip)


#: Rows whose results are sent on together: tensors may be a megabyte each.
ROWS = 64


def slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def array_of(values: list, kind: pa.DataType) -> pa.Array:
    """Tensors become flat buffers with offsets; other values are converted one by one."""
    if kind != _TENSOR:
        return pa.array(values, kind)
    flat = [np.zeros(0, np.float32) if v is None else v["data"] for v in values]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
    data = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.float32), pa.float32()))
    shape = pa.array([None if v is None else v["shape"] for v in values], pa.list_(pa.int32()))
    return pa.StructArray.from_arrays([shape, data], fields=list(_TENSOR), mask=pa.array([v is None for v in values]))


def _apply(df: DataFrame, col: str, out: str, kind: pa.DataType, ddl: str, f) -> DataFrame:
    """Each row with f(image) instead of the image column; rows stay where they are."""
    prepare(df.sparkSession)

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index(col)
            made = array_of([None if v is None else f(_image(v)) for v in b.column(at).to_pylist()], kind)
            rest = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), made], [*(b.schema.names[i] for i in rest), out])

    return df.mapInArrow(run, _schema(df, col) + f"`{out}` {ddl}")


_PIXELS = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])
_TENSOR = pa.struct([("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32()))])
IMAGE_DDL = "struct<width:int,height:int,data:binary>"
TENSOR_DDL = "struct<shape:array<int>,data:array<float>>"


def pack(x: np.ndarray) -> dict:
    return {"width": x.shape[1], "height": x.shape[0], "data": x.tobytes()}


def pack_tensor(x: np.ndarray) -> dict:
    return {"shape": list(x.shape), "data": x.astype(np.float32).ravel()}


def resize(df: DataFrame, width: int, height: int, name: str = "bicubic", col: str = "image") -> DataFrame:
    return _apply(df, col, col, _PIXELS, IMAGE_DDL, lambda x: pack(k.resize(k.to_rgb(x), width, height, name)))


def resize_bilinear_no_antialias(df: DataFrame, width: int, height: int, col: str = "image") -> DataFrame:
    return _apply(df, col, col, _PIXELS, IMAGE_DDL, lambda x: pack(k.resize_bilinear_no_antialias(k.to_rgb(x), width, height)))


def center_crop(df: DataFrame, width: int, height: int, col: str = "image") -> DataFrame:
    return _apply(df, col, col, _PIXELS, IMAGE_DDL, lambda x: pack(k.center_crop(k.to_rgb(x), width, height)))


def letterbox(df: DataFrame, width: int, height: int, fill=(114, 114, 114), name: str = "bilinear", col: str = "image") -> DataFrame:
    return _apply(df, col, col, _PIXELS, IMAGE_DDL, lambda x: pack(k.letterbox(k.to_rgb(x), width, height, fill, name)))


def process(df: DataFrame, plan: ImageProcessor, col: str = "image", out: str = "tensor") -> DataFrame:
    """RGB, resize, crop and tensor of each image."""
    return _apply(df, col, out, _TENSOR, TENSOR_DDL, lambda x: pack_tensor(k.process(x, plan)))


def prepared(df: DataFrame, plan: ImageProcessor, col: str = "image") -> DataFrame:
    """RGB, resize and crop of each image, before it becomes a tensor."""
    return _apply(df, col, col, _PIXELS, IMAGE_DDL, lambda x: pack(k.prepare(x, plan)))


def process_batch(df: DataFrame, plan: ImageProcessor, batch: list[str], col: str = "image", out: str = "tensor") -> DataFrame:
    """As `process`; raises if the tensors of a batch (rows of equal batch columns) differ in shape."""
    done = process(df, plan, col, out)
    shapes = done.groupBy(*batch).agg(F.min(F.col(f"{out}.shape")).alias("_a"), F.max(F.col(f"{out}.shape")).alias("_b"))
    checked = shapes.select(*batch, F.assert_true(F.col("_a") == F.col("_b"), F.lit("images of a batch have different sizes")).alias("_ok"))
    return done.join(checked.filter("_ok is null"), batch).drop("_ok")


def tiles(df: DataFrame, plan: TileProcessor, col: str = "image") -> DataFrame:
    """One row per tile: the input's other columns, tile_idx, tile_row, tile_col, is_global, tensor."""
    prepare(df.sparkSession)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(col)
            rest = [i for i in range(b.num_columns) if i != at]
            for row in range(b.num_rows):
                v = b.column(at)[row].as_py()
                if v is None:
                    continue
                made = [(i, r, c, g, pack_tensor(t)) for i, (r, c, g, t) in enumerate(k.tiles(_image(v), plan))]
                cols = [array_of(list(x), t) for x, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), _TENSOR))]
                picked = [b.column(i).take(pa.array([row] * len(made))) for i in rest]
                yield pa.RecordBatch.from_arrays([*picked, *cols], [*(b.schema.names[i] for i in rest), "tile_idx", "tile_row", "tile_col", "is_global", "tensor"])

    return df.mapInArrow(run, _schema(df, col) + f"tile_idx int, tile_row int, tile_col int, is_global boolean, tensor {TENSOR_DDL}")


#: Values of an image that make one row on their way to the JVM, and values that are sent on together.
PART, SENT = 1 << 16, 1 << 22


def explode_pixels(df: DataFrame, key: list[str], col: str = "image") -> DataFrame:
    """(key, y, x, c, v) of each pixel. The kernel only turns bytes into arrays, as the JVM reads a binary column one value at a
    time from its beginning; the rows are made in the JVM."""
    prepare(df.sparkSession)
    size = F.octet_length(F.col(f"{col}.data"))
    width, area = F.col(f"{col}.width"), F.col(f"{col}.width") * F.col(f"{col}.height")
    source = df.filter(size > 0).select(*key, width.alias("_w"), (size / area).cast("int").alias("_n"), F.col(f"{col}.data").alias("_d"))

    def run(batches):
        for b in slices(batches):
            origin, begin, parts, held = [], [], [], 0

            def made():
                take, offsets = pa.array(origin, pa.int64()), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))
                return pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:-1]), pa.array(begin, pa.int32()), values], [*b.schema.names[:-1], "_at", "_v"])

            for i in range(b.num_rows):
                data = np.frombuffer(b.column(b.num_columns - 1)[i].as_buffer(), np.uint8)
                for at in range(0, len(data), PART):
                    origin.append(i)
                    begin.append(at)
                    parts.append(data[at : at + PART])
                    held += len(parts[-1])
                    if held >= SENT:
                        yield made()
                        origin, begin, parts, held = [], [], [], 0
            if origin:
                yield made()

    sent = source.mapInArrow(run, _schema(source, "_d") + "_at int, _v array<int>")
    rows = sent.select(*key, "_w", "_n", "_at", F.posexplode("_v").alias("_p", "v")).select(*key, "_w", "_n", (F.col("_at") + F.col("_p")).alias("_i"), "v")
    return rows.select(*key, F.expr("int(_i div (_w * _n))").alias("y"), F.expr("int(_i div _n % _w)").alias("x"), (F.col("_i") % F.col("_n")).alias("c"), "v")


def weight_rows(spark, size: int, out: int, name: str) -> DataFrame:
    """(out, tap, pos, w): the fixed-point weights of one axis, a table of a few rows per output position."""
    first, w = k.axis_weights(size, out, name)
    rows = [(o, t, int(first[o]) + t, int(w[o, t])) for o in range(out) for t in range(w.shape[1]) if first[o] + t < size and w[o, t]]
    return spark.createDataFrame(rows, "out int, tap int, pos int, w bigint")


def resize_pixels(pixels: DataFrame, width: int, height: int, name: str, key: list[str], size: tuple[int, int]) -> DataFrame:
    """The resize of `resize` on pixel rows of images of one size (width, height): two joins with weight tables and integer sums."""
    spark = pixels.sparkSession
    clip = lambda total: F.greatest(F.least(F.shiftright(total + (1 << 21), 22), F.lit(255)), F.lit(0)).cast("int")
    w, h = size
    if w != width:
        rows = F.broadcast(weight_rows(spark, w, width, name))
        pixels = pixels.join(rows, pixels.x == rows.pos).groupBy(*key, "y", F.col("out").alias("x_"), "c").agg(clip(F.sum(F.col("v") * F.col("w"))).alias("v")).withColumnRenamed("x_", "x")
    if h != height:
        rows = F.broadcast(weight_rows(spark, h, height, name))
        pixels = pixels.join(rows, pixels.y == rows.pos).groupBy(*key, F.col("out").alias("y_"), "x", "c").agg(clip(F.sum(F.col("v") * F.col("w"))).alias("v")).withColumnRenamed("y_", "y")
    return pixels.select(*key, "y", "x", "c", "v")

"""Image sizes of part, pixels of supplier."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import image as op
from ..plans.image import ImageProcessor, Size, TileProcessor
from ..session import prepare, spread
from ..sources import media
from . import query, table

_W, _H = "CAST(16 + (p_partkey * 37) % 2000 AS INT)", "CAST(16 + (p_size * 61 + p_partkey * 7) % 1500 AS INT)"
_S = f"s AS (SELECT p_partkey, {_W} AS w, {_H} AS h, ({_W})::DOUBLE AS wd, ({_H})::DOUBLE AS hd FROM part)"


def sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_W} AS w", f"{_H} AS h")


def _sized(size):
    def run(spark, sf_dir):
        return sizes(spark, sf_dir).select("p_partkey", size.column("w", "h").alias("o")).select("p_partkey", "o.width", "o.height")

    return run


query(f"WITH {_S} SELECT p_partkey, 224 AS width, 196 AS height FROM s", "size_exact")(_sized(Size.exact(224, 196)))
_SHORT = "SELECT p_partkey, w, h, 224.0::DOUBLE AS s0, trunc(224.0::DOUBLE * greatest(wd, hd) / least(wd, hd)) AS l0 FROM s"
query(
    f"WITH {_S}, a AS ({_SHORT}) SELECT p_partkey, (CASE WHEN w <= h THEN s0 ELSE l0 END)::INT AS width, (CASE WHEN w <= h THEN l0 ELSE s0 END)::INT AS height FROM a", "size_shortest_edge"
)(_sized(Size.shortest_edge(224)))
query(
    f"WITH {_S}, a AS ({_SHORT}), b AS (SELECT *, CASE WHEN l0 > 300 THEN trunc(300.0::DOUBLE * s0 / l0) ELSE s0 END AS s1, least(l0, 300) AS l1 FROM a) "
    "SELECT p_partkey, (CASE WHEN w <= h THEN s1 ELSE l1 END)::INT AS width, (CASE WHEN w <= h THEN l1 ELSE s1 END)::INT AS height FROM b", "size_shortest_edge_capped",
)(_sized(Size.shortest_edge(224, 300)))
query(
    f"WITH {_S}, a AS (SELECT *, 512.0::DOUBLE / greatest(wd, hd) AS k FROM s) SELECT p_partkey, trunc(wd * k + 0.5)::INT AS width, trunc(hd * k + 0.5)::INT AS height FROM a", "size_longest_edge"
)(_sized(Size.longest_edge(512)))
query(
    f"""WITH {_S}, a AS (SELECT *, 28 * round_even(wd / 28, 0) AS rw, 28 * round_even(hd / 28, 0) AS rh, sqrt(hd * wd / 500000.0::DOUBLE) AS d, sqrt(200000.0::DOUBLE / (hd * wd)) AS u FROM s)
    SELECT p_partkey,
      (CASE WHEN rw * rh > 500000 THEN greatest(28, 28 * floor(wd / d / 28)) WHEN rw * rh < 200000 THEN 28 * ceil(wd * u / 28) ELSE rw END)::INT AS width,
      (CASE WHEN rw * rh > 500000 THEN greatest(28, 28 * floor(hd / d / 28)) WHEN rw * rh < 200000 THEN 28 * ceil(hd * u / 28) ELSE rh END)::INT AS height FROM a""", "size_multiple",
)(_sized(Size.multiple(28, 200_000, 500_000)))


@query(
    f"""WITH {_S}, a AS (SELECT *, least(640.0::DOUBLE / wd, 480.0::DOUBLE / hd) AS r FROM s),
    b AS (SELECT *, least(greatest(round_even(wd * r, 0), 1), 640) AS iw, least(greatest(round_even(hd * r, 0), 1), 480) AS ih FROM a)
    SELECT p_partkey, iw::INT AS width, ih::INT AS height, greatest(round_even((640 - iw) / 2 - 0.1::DOUBLE, 0), 0)::INT AS "left", greatest(round_even((480 - ih) / 2 - 0.1::DOUBLE, 0), 0)::INT AS top FROM b"""
)
def letterbox_geometry(spark, sf_dir):
    return sizes(spark, sf_dir).select("p_partkey", g.letterbox("w", "h", 640, 480).alias("o")).select("p_partkey", "o.*")


_TILES = f"""{_S},
a AS (SELECT p_partkey, CASE WHEN wd >= hd THEN 1456 ELSE trunc(1456 * (wd / hd)) + trunc(1456 * (wd / hd)) % 2 END AS w0, CASE WHEN wd >= hd THEN trunc(1456 / (wd / hd)) + trunc(1456 / (wd / hd)) % 2 ELSE 1456 END AS h0 FROM s),
b AS (SELECT p_partkey, greatest(w0, 1)::DOUBLE AS w1, greatest(h0, 1)::DOUBLE AS h1 FROM a),
c AS (SELECT *, CASE WHEN w1 >= h1 THEN ceil(w1 / 364) * 364 ELSE ceil(trunc(ceil(h1 / 364) * 364 * (w1 / h1)) / 364) * 364 END AS w2, CASE WHEN w1 >= h1 THEN ceil(trunc(ceil(w1 / 364) * 364 / (w1 / h1)) / 364) * 364 ELSE ceil(h1 / 364) * 364 END AS h2 FROM b),
t AS (SELECT p_partkey, w1::INT AS scaled_w, h1::INT AS scaled_h, w2::INT AS padded_w, h2::INT AS padded_h, (CASE WHEN w2 > 364 OR h2 > 364 THEN trunc(h2 / 364) ELSE 0 END)::INT AS rows, (CASE WHEN w2 > 364 OR h2 > 364 THEN trunc(w2 / 364) ELSE 0 END)::INT AS cols FROM c)"""


def tile_plans(spark, sf_dir):
    p = TileProcessor()
    return sizes(spark, sf_dir).select("p_partkey", g.tile_plan("w", "h", p.longest_edge, p.tile).alias("t")).select(
        "p_partkey", F.col("t.scaled.width").alias("scaled_w"), F.col("t.scaled.height").alias("scaled_h"), F.col("t.padded.width").alias("padded_w"), F.col("t.padded.height").alias("padded_h"), "t.rows", "t.cols"
    )


@query(f"WITH {_TILES} SELECT *, rows > 0 AND cols > 0 AS has_global FROM t")
def tile_geometry(spark, sf_dir):
    return tile_plans(spark, sf_dir).withColumn("has_global", g.has_global("rows", "cols"))


@query(
    f"""WITH {_TILES} SELECT p_partkey, r::INT AS tile_row, c::INT AS tile_col, FALSE AS is_global FROM t, range(greatest(rows, 1)) a(r), range(greatest(cols, 1)) b(c)
    UNION ALL SELECT p_partkey, rows, cols, TRUE FROM t WHERE rows > 0"""
)
def tile_grid(spark, sf_dir):
    t = tile_plans(spark, sf_dir)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    grid = t.select("p_partkey", upto("rows").alias("tile_row"), "cols").select("p_partkey", "tile_row", upto("cols").alias("tile_col"), F.lit(False).alias("is_global"))
    return grid.unionByName(t.filter("rows > 0").select("p_partkey", F.col("rows").alias("tile_row"), F.col("cols").alias("tile_col"), F.lit(True).alias("is_global")))


# Pixels: 16 x 12 images of each supplier.
_V = "CAST((s_suppkey * 31 + y * 17 + x * 29 + c * 53 + x * y * 7) % 256 AS INT)"
_P = f"p AS (SELECT s_suppkey AS img_id, y::INT AS y, x::INT AS x, c::INT AS c, {_V} AS v FROM supplier, range(12) a(y), range(16) b(x), range(3) d(c))"
IMG = ["img_id"]


def pixels(spark, sf_dir):
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Dealt by image, so sums over pixels of an image need no further shuffle and a task holds few of them.
    s = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", to(12).alias("y")).select("*", to(16).alias("x")).select("*", to(3).alias("c"))
    return s.selectExpr("s_suppkey AS img_id", "y", "x", "c", f"{_V} AS v")


def images(spark, sf_dir):
    prepare(spark)

    def run(batches):
        y, x, c = np.mgrid[0:12, 0:16, 0:3]
        for b in batches:
            made = [op.pack(((k * 31 + y * 17 + x * 29 + c * 53 + x * y * 7) % 256).astype(np.uint8)) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, op._PIXELS)], ["img_id", "image"])

    return spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("img_id"))).mapInArrow(run, f"img_id long, image {op.IMAGE_DDL}")


def _weights(pairs):
    """Weight tables for (size, out, filter) triples, and the sums in order."""
    rows = ", ".join(f"({s}, {o}, '{f}', {u}::DOUBLE)" for s, o, f in pairs for u in [{"box": 0.5, "bilinear": 1.0, "hamming": 1.0, "bicubic": 2.0, "lanczos": 3.0}[f]])
    sinc = lambda v: f"(CASE WHEN {v} = 0 THEN 1.0::DOUBLE ELSE sin(pi() * {v}) / (pi() * {v}) END)"
    return f"""cfg(size, outn, f, support) AS (VALUES {rows}),
    o AS (SELECT cfg.*, u.o::INT AS o, size::DOUBLE / outn AS scale FROM cfg, LATERAL (SELECT unnest(range(outn)) AS o) u),
    q AS (SELECT *, (o + 0.5::DOUBLE) * scale AS center, greatest(scale, 1.0::DOUBLE) AS widen FROM o),
    q2 AS (SELECT *, greatest(trunc(center - support * widen + 0.5::DOUBLE), 0)::INT AS first, least(trunc(center + support * widen + 0.5::DOUBLE), size)::INT AS last FROM q),
    q3 AS (SELECT q2.*, u.x::INT AS tap, (u.x + first - center + 0.5::DOUBLE) * (1.0::DOUBLE / widen) AS d FROM q2, LATERAL (SELECT unnest(range(last - first)) AS x) u),
    q4 AS (SELECT *, CASE f WHEN 'box' THEN CASE WHEN d > -0.5 AND d <= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN 'bilinear' THEN greatest(1.0::DOUBLE - abs(d), 0.0::DOUBLE)
      WHEN 'hamming' THEN CASE WHEN abs(d) >= 1 THEN 0.0::DOUBLE ELSE {sinc("d")} * (0.54::FLOAT::DOUBLE + 0.46::FLOAT::DOUBLE * cos(pi() * d)) END
      WHEN 'lanczos' THEN CASE WHEN d >= -3 AND d < 3 THEN {sinc("d")} * {sinc("(d / 3)")} ELSE 0.0::DOUBLE END
      ELSE CASE WHEN abs(d) < 1 THEN (1.5::DOUBLE * abs(d) - 2.5::DOUBLE) * abs(d) * abs(d) + 1.0::DOUBLE WHEN abs(d) < 2 THEN (((abs(d) - 5.0::DOUBLE) * abs(d) + 8.0::DOUBLE) * abs(d) - 4.0::DOUBLE) * -0.5::DOUBLE ELSE 0.0::DOUBLE END END AS raw FROM q3),
    q5 AS (SELECT size, outn, f, o, list_reduce(list(raw ORDER BY tap), lambda a, b: a + b) AS total FROM q4 GROUP BY ALL),
    wt AS (SELECT size, outn, f, o, tap, first + tap AS pos, trunc(raw / total * 4194304 + CASE WHEN raw / total < 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END)::BIGINT AS w FROM q4 JOIN q5 USING (size, outn, f, o))"""


_GRID = [(16, 9, "bicubic"), (12, 20, "bicubic"), (16, 24, "bilinear"), (12, 5, "bilinear"), (100, 37, "box"), (37, 100, "box"), (640, 224, "bicubic"), (224, 640, "bilinear"), (64, 20, "lanczos"), (20, 64, "hamming"), (90, 31, "hamming"), (31, 90, "lanczos")]


@query(f"WITH {_weights(_GRID)} SELECT size, outn, f, o AS out, tap, pos, w FROM wt WHERE w <> 0")
def resize_weights(spark, sf_dir):
    parts = [op.weight_rows(spark, s, o, f).select(F.lit(s).alias("size"), F.lit(o).alias("outn"), F.lit(f).alias("f"), "out", "tap", "pos", "w") for s, o, f in _GRID]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scaled(source, target, size, out, name):
    """CTEs that resize the pixel rows of `source`, and the weights that they need. An axis that keeps its size is left alone."""
    clip = "greatest(least((sum(v * w) + 2097152)::BIGINT >> 22, 255), 0)::INT"
    use = lambda axis, a, b: f"wt ON p.{axis} = wt.pos AND wt.size = {a} AND wt.outn = {b} AND wt.f = '{name}'"
    across = f"SELECT img_id, y, o AS x, c, {clip} AS v FROM {source} p JOIN {use('x', size[0], out[0])} GROUP BY img_id, y, o, c" if size[0] != out[0] else f"SELECT * FROM {source}"
    down = f"SELECT img_id, o AS y, x, c, {clip} AS v FROM {target}_x p JOIN {use('y', size[1], out[1])} GROUP BY img_id, o, x, c" if size[1] != out[1] else f"SELECT * FROM {target}_x"
    return f"{target}_x AS ({across}), {target} AS ({down})", [(a, b, name) for a, b in zip(size, out)]


def _resized(width, height, name):
    ctes, pairs = _scaled("p", "r", (16, 12), (width, height), name)
    return f"WITH {_P}, {_weights(pairs)}, {ctes} SELECT img_id, y, x, c, v FROM r"


def _normal(v, mean, std):
    pick = lambda m: f"(CASE c WHEN 0 THEN {m[0]} WHEN 1 THEN {m[1]} ELSE {m[2]} END)::FLOAT"
    return f"((({v}::DOUBLE * (1.0::DOUBLE / 255.0::DOUBLE))::FLOAT - {pick(mean)})::FLOAT / {pick(std)})::FLOAT"


@query(_resized(9, 20, "bicubic"))
def resize_pixels(spark, sf_dir):
    return op.resize_pixels(pixels(spark, sf_dir), 9, 20, "bicubic", IMG, (16, 12))


@query(_resized(9, 20, "bicubic"))
def resize_kernel_bicubic(spark, sf_dir):
    return op.explode_pixels(op.resize(images(spark, sf_dir), 9, 20, "bicubic"), IMG)


@query(_resized(24, 5, "bilinear"))
def resize_kernel_bilinear(spark, sf_dir):
    return op.explode_pixels(op.resize(images(spark, sf_dir), 24, 5, "bilinear"), IMG)


for _name in ("lanczos", "hamming", "box"):
    query(_resized(9, 20, _name), f"resize_kernel_{_name}")(lambda spark, sf_dir, f=_name: op.explode_pixels(op.resize(images(spark, sf_dir), 9, 20, f), IMG))


def _steps(size, out):
    return f"(SELECT o, least({size} - 1, trunc(sum(CASE WHEN o = 0 THEN {size}::DOUBLE / {out} / 2 ELSE {size}::DOUBLE / {out} END) OVER (ORDER BY o)))::INT AS s FROM range({out}) r(o))"


@query(f"WITH {_P} SELECT img_id, a.o::INT AS y, b.o::INT AS x, c, v FROM {_steps(12, 8)} a, {_steps(16, 32)} b JOIN p ON p.y = a.s AND p.x = b.s")
def resize_nearest(spark, sf_dir):
    return op.explode_pixels(op.resize(images(spark, sf_dir), 32, 8, "nearest"), IMG)


def _linear(size, out):
    return f"""SELECT o::INT AS o, i::INT AS i, CASE WHEN i + 1 >= {size} THEN 1.0::DOUBLE ELSE 1 - f END AS a, CASE WHEN i + 1 >= {size} THEN 0.0::DOUBLE ELSE f END AS b, least(i + 1, {size} - 1)::INT AS j FROM (
      SELECT o, least(floor(r), {size} - 1) AS i, r - least(floor(r), {size} - 1) AS f FROM (SELECT o, greatest({size}::DOUBLE / {out} * (o + 0.5::DOUBLE) - 0.5::DOUBLE, 0.0::DOUBLE) AS r FROM range({out}) t(o)))"""


def _bits(name):
    return f"(SELECT max(p) FROM range(23) r(p), (SELECT max(greatest(a, b)) AS m FROM {name}) WHERE p = 0 OR trunc(0.5::DOUBLE + m * (1::BIGINT << p)) < 32768)"


@query(
    f"""WITH {_P}, lx AS ({_linear(16, 11)}), ly AS ({_linear(12, 19)}), bx AS (SELECT {_bits('lx')} AS n), by_ AS (SELECT {_bits('ly')} AS n),
    hz AS (SELECT p.img_id, p.y, o AS x, p.c, greatest(least((p.v * trunc(0.5::DOUBLE + a * (1::BIGINT << n))::BIGINT + q.v * trunc(0.5::DOUBLE + b * (1::BIGINT << n))::BIGINT + (1::BIGINT << (n - 1))) >> n, 255), 0)::INT AS v
      FROM lx, bx JOIN p ON p.x = lx.i JOIN p q ON q.img_id = p.img_id AND q.y = p.y AND q.c = p.c AND q.x = lx.j)
    SELECT p.img_id, o AS y, p.x, p.c, greatest(least((p.v * trunc(0.5::DOUBLE + a * (1::BIGINT << n))::BIGINT + q.v * trunc(0.5::DOUBLE + b * (1::BIGINT << n))::BIGINT + (1::BIGINT << (n - 1))) >> n, 255), 0)::INT AS v
      FROM ly, by_ JOIN hz p ON p.y = ly.i JOIN hz q ON q.img_id = p.img_id AND q.x = p.x AND q.c = p.c AND q.y = ly.j"""
)
def resize_no_antialias(spark, sf_dir):
    return op.explode_pixels(op.resize_bilinear_no_antialias(images(spark, sf_dir), 11, 19), IMG)


@query(
    f"""WITH {_P}, g AS (SELECT s_suppkey AS img_id, y::INT AS y, x::INT AS x, c::INT AS c FROM supplier, range(17) a(y), range(7) b(x), range(3) d(c))
    SELECT g.img_id, g.y, g.x, g.c, coalesce(p.v, 0) AS v FROM g LEFT JOIN p ON p.img_id = g.img_id AND p.y = g.y - 3 AND p.x = g.x + 4 AND p.c = g.c"""
)
def center_crop(spark, sf_dir):
    return op.explode_pixels(op.center_crop(images(spark, sf_dir), 7, 17), IMG)


_BOXED = _scaled("p", "r", (16, 12), (20, 15), "bilinear")


@query(
    f"""WITH {_P}, {_weights(_BOXED[1])}, {_BOXED[0]}, g AS (SELECT s_suppkey AS img_id, y::INT AS y, x::INT AS x, c::INT AS c FROM supplier, range(20) a(y), range(20) b(x), range(3) d(c))
    SELECT g.img_id, g.y, g.x, g.c, coalesce(r.v, 114) AS v FROM g LEFT JOIN r ON r.img_id = g.img_id AND r.y = g.y - 2 AND r.x = g.x AND r.c = g.c"""
)
def letterbox_pixels(spark, sf_dir):
    return op.explode_pixels(op.letterbox(images(spark, sf_dir), 20, 20), IMG)


_MEAN, _STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


@query(f"WITH {_P} SELECT img_id, ((c * 12 + y) * 16 + x)::INT AS pos, {_normal('v', _MEAN, _STD)} AS v FROM p")
def to_tensor(spark, sf_dir):
    done = op.process(images(spark, sf_dir), ImageProcessor(mean=_MEAN, std=_STD))
    return done.select("img_id", F.posexplode("tensor.data").alias("pos", "v"))


_WHOLE = _scaled("p", "r", (16, 12), (42, 32), "bicubic")


@query(f"WITH {_P}, {_weights(_WHOLE[1])}, {_WHOLE[0]} SELECT img_id, ((c * 32 + y) * 32 + x - 5)::INT AS pos, {_normal('v', _MEAN, _STD)} AS v FROM r WHERE x BETWEEN 5 AND 36")
def process_images(spark, sf_dir):
    """Every value of resized, cropped and normalised images, in batches of one shape."""
    plan = ImageProcessor(resize=Size.shortest_edge(32), crop=(32, 32), mean=_MEAN, std=_STD)
    done = op.process_batch(images(spark, sf_dir).withColumn("batch", F.col("img_id") % 7), plan, ["batch"])
    return done.select("img_id", F.posexplode("tensor.data").alias("pos", "v"))


@query(f"WITH {_P}, {_weights(_WHOLE[1])}, {_WHOLE[0]} SELECT img_id, y, x - 5 AS x, c, v FROM r WHERE x BETWEEN 5 AND 36")
def prepare_images(spark, sf_dir):
    """Pixels after resize and crop, before they become tensors."""
    plan = ImageProcessor(resize=Size.shortest_edge(32), crop=(32, 32))
    return op.explode_pixels(op.prepared(images(spark, sf_dir), plan), IMG)


_LARGE, _VIEW = _scaled("p", "r", (16, 12), (64, 48), "lanczos"), _scaled("r", "g", (64, 48), (16, 16), "lanczos")
_HALF = (0.5, 0.5, 0.5)


@query(
    f"""WITH {_P}, {_weights(_LARGE[1] + _VIEW[1])}, {_LARGE[0]}, {_VIEW[0]},
    t AS (SELECT img_id, (y // 16 * 4 + x // 16)::INT AS tile_idx, FALSE AS is_global, ((c * 16 + y % 16) * 16 + x % 16)::INT AS pos, c, v FROM r
      UNION ALL SELECT img_id, 12, TRUE, ((c * 16 + y) * 16 + x)::INT, c, v FROM g)
    SELECT img_id, tile_idx, is_global, pos, {_normal('v', _HALF, _HALF)} AS v FROM t"""
)
def tile_pixels(spark, sf_dir):
    """Every value of every tile, the view of the whole image included."""
    done = op.tiles(images(spark, sf_dir), TileProcessor(longest_edge=64, tile=16))
    return done.select("img_id", "tile_idx", "is_global", F.posexplode("tensor.data").alias("pos", "v"))


_CONFIGS = {
    "short": '{"size": %d, "crop_size": {"height": %d, "width": 21}, "do_center_crop": true, "resample": 2}',
    "square": '{"size": %d, "image_mean": 0.5, "image_std": [0.5, 0.25, %d], "do_normalize": true}',
    "longest": '{"size": {"longest_edge": %d}, "resample": 1, "rescale_factor": 0.0%d}',
    "pixels": '{"min_pixels": %d, "max_pixels": 9%d, "patch_size": 14, "merge_size": 2, "size": 3, "do_rescale": false}',
    "none": '{"do_resize": false, "size": %d, "resample": %d}',
}


@query(
    """WITH c AS (SELECT p_partkey, 100 + p_size AS a, 1 + p_partkey % 4 AS b FROM part)
    SELECT p_partkey, 'short' AS kind, 'shortest ' || a AS size, 'bilinear' AS resample, '21x' || b AS crop, 0.00392::DOUBLE AS rescale, NULL AS std FROM c
    UNION ALL SELECT p_partkey, 'square', 'exact ' || a || ' ' || a, 'bicubic', NULL, 0.00392, '0.5 0.25 ' || b || '.0' FROM c
    UNION ALL SELECT p_partkey, 'longest', 'longest ' || a, 'lanczos', NULL, round(b / 100.0::DOUBLE, 5), NULL FROM c
    UNION ALL SELECT p_partkey, 'pixels', 'multiple 28 ' || a || ' 9' || b, 'bicubic', NULL, NULL, NULL FROM c
    UNION ALL SELECT p_partkey, 'none', NULL, CASE b WHEN 1 THEN 'lanczos' WHEN 2 THEN 'bilinear' WHEN 3 THEN 'bicubic' ELSE 'box' END, NULL, 0.00392, NULL FROM c"""
)
def image_configs(spark, sf_dir):
    """Configurations as JSON text, one of each kind per part, read by `ImageProcessor.from_config`."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_size")).cast("long").alias("a"), (1 + F.col("p_partkey") % 4).cast("long").alias("b"))
    texts = F.map_from_arrays(F.array(*[F.lit(k) for k in _CONFIGS]), F.array(*[F.format_string(v, "a", "b") for v in _CONFIGS.values()]))
    rows = rows.select("p_partkey", F.explode(texts).alias("kind", "config"))
    prepare(spark)

    def read(batches):
        for b in batches:
            plans = [ImageProcessor.from_config(c) for c in b.column(2).to_pylist()]
            out = {
                "size": [p.resize and " ".join(map(str, [p.resize.kind, *(v for v in p.resize.values if v is not None)])) for p in plans], "resample": [p.resample for p in plans], "crop": [p.crop and f"{p.crop[0]}x{p.crop[1]}" for p in plans],
                "rescale": pa.array([None if p.rescale is None else round(p.rescale, 5) for p in plans], pa.float64()), "std": pa.array([p.std and " ".join(map(str, p.std)) for p in plans], pa.string()),
            }
            out = {k: v if isinstance(v, pa.Array) else pa.array(v, pa.string()) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *out.values()], ["p_partkey", "kind", *out])

    return rows.mapInArrow(read, "p_partkey long, kind string, size string, resample string, crop string, rescale double, std string")


def _files(spark, sf_dir, encode):
    """(path, content): a file of each image, path being its number."""
    prepare(spark)

    def run(batches):
        for b in batches:
            made = [encode(np.frombuffer(v["data"], np.uint8).reshape(v["height"], v["width"], 3), i) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return images(spark, sf_dir).mapInArrow(run, "path string, content binary")


def _read_back(files):
    return op.explode_pixels(media.decode_images(files).select(F.col("path").cast("long").alias("img_id"), "image"), IMG)


@query(f"WITH {_P} SELECT img_id, y, x, c, v FROM p")
def decode_png(spark, sf_dir):
    """PNG files with all five row filters, every other one interlaced."""
    return _read_back(_files(spark, sf_dir, lambda x, i: media.encode_png(x, (4, 3, 2, 1, 0), i % 2 == 1)))


@query(f"WITH {_P} SELECT img_id, y, x, c, v FROM p")
def decode_pnm(spark, sf_dir):
    return _read_back(_files(spark, sf_dir, lambda x, i: b"P6\n# a comment\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes()))


@query("SELECT s_suppkey AS img_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 16 END::INT AS width, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown image format' END AS error FROM supplier")
def decode_errors(spark, sf_dir):
    """Files of which every third is none of the formats: they stay, with an error."""
    files = _files(spark, sf_dir, lambda x, i: b"no image" if i % 3 == 0 else media.encode_png(x))
    return media.decode_images(files, tolerant=True).select(F.col("path").cast("long").alias("img_id"), "image.width", "error")


@query("SELECT vec_id, i::INT AS pos, embedding[i + 1]::FLOAT::DOUBLE AS v FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS i)")
def decode_npy(spark, sf_dir):
    """Arrays written as `.npy` files and read."""
    prepare(spark)

    def run(batches):
        import io

        for b in batches:
            made = []
            for v in b.column(1).to_pylist():
                out = io.BytesIO()
                np.save(out, np.array(v, np.float32))
                made.append(media.read_npy(out.getvalue()).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.float64()))], ["vec_id", "x"])

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("embedding is not null")
    return rows.mapInArrow(run, "vec_id long, x array<double>").select("vec_id", F.posexplode("x").alias("pos", "v"))

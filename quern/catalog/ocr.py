"""Text-box geometry: quads of part, 8 x 8 maps of embeddings, hashed images of supplier."""

from pyspark.sql import functions as F

from ..kernels.ocr import DbDecoder
from ..operators import ocr as op
from ..session import spread
from . import query, table
from .images import images

# Four corners in any order, for both engines.
_X = ["(p_partkey * 13) % 200", "(p_partkey * 13) % 200 + 20 + p_size", "(p_partkey * 13) % 200 + 25 + p_size", "(p_partkey * 13) % 200 + 3"]
_Y = ["(p_partkey * 7) % 150", "(p_partkey * 7) % 150 + 4 + p_partkey % 5", "(p_partkey * 7) % 150 + 14 + p_size % 9", "(p_partkey * 7) % 150 + 11"]
_TURN = [[(i * s + r) % 4 for i in range(4)] for r, s in ((0, 1), (1, 1), (2, 3), (3, 3))]


def quads(spark, sf_dir):
    q = lambda order: "array(" + ", ".join(f"named_struct('x', CAST({_X[i]} AS FLOAT), 'y', CAST({_Y[i]} AS FLOAT))" for i in order) + ")"
    cases = " ".join(f"WHEN {k} THEN {q(o)}" for k, o in enumerate(_TURN))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), rows=1 << 14).selectExpr("p_partkey", f"CASE p_partkey % 4 {cases} END AS quad")


_Q = "q AS (SELECT p_partkey, CASE p_partkey % 4 " + " ".join("WHEN " + str(k) + " THEN [" + ", ".join(f"struct_pack(x := CAST({_X[i]} AS FLOAT), y := CAST({_Y[i]} AS FLOAT))" for i in o) + "]" for k, o in enumerate(_TURN)) + " END AS quad FROM part)"


def flat(df, quad, *keys):
    return df.select(*keys, *[F.get(quad, F.lit(i))[c].alias(f"{c}{i}") for i in range(4) for c in ("x", "y")])


@query(
    f"""WITH {_Q}, s AS (SELECT p_partkey, list_sort(list_transform(quad, lambda v, i: struct_pack(x := v.x, i := i, y := v.y))) AS p FROM q),
    o AS (SELECT p_partkey, CASE WHEN p[2].y > p[1].y THEN [p[1], p[2]] ELSE [p[2], p[1]] END AS l, CASE WHEN p[4].y > p[3].y THEN [p[3], p[4]] ELSE [p[4], p[3]] END AS r FROM s)
    SELECT p_partkey, l[1].x AS x0, l[1].y AS y0, r[1].x AS x1, r[1].y AS y1, r[2].x AS x2, r[2].y AS y2, l[2].x AS x3, l[2].y AS y3 FROM o"""
)
def order_corners(spark, sf_dir):
    return flat(quads(spark, sf_dir).withColumn("o", op.order_corners(F.col("quad"))), F.col("o"), "p_partkey")


def _edges():
    """Per corner: its point, edge direction and outward normal; in wide form over the quad's four rows."""
    return f"""{_Q}, e AS (SELECT p_partkey, i, quad[i].x::DOUBLE AS x, quad[i].y::DOUBLE AS y, quad[i % 4 + 1].x::DOUBLE AS nx, quad[i % 4 + 1].y::DOUBLE AS ny FROM q, range(1, 5) r(i)),
    l AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len FROM e),
    t AS (SELECT p_partkey, sum(len ORDER BY i) AS around, sum(x * ny - nx * y ORDER BY i) AS turn FROM l GROUP BY p_partkey),
    d AS (SELECT l.*, abs(turn) / 2 * 1.5::DOUBLE / around AS away, CASE WHEN turn > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, (nx - x) / greatest(len, 1e-6::DOUBLE) AS dx, (ny - y) / greatest(len, 1e-6::DOUBLE) AS dy FROM l JOIN t USING (p_partkey)),
    m AS (SELECT *, x + away * dy * sign AS mx, y - away * dx * sign AS my, dy * sign AS ox, -dx * sign AS oy FROM d),
    c AS (SELECT a.p_partkey, a.i, b.dx * a.dy - b.dy * a.dx AS cr, a.x, a.y, a.away, a.mx, a.my, a.dx, a.dy, a.ox, a.oy, b.mx AS sx, b.my AS sy, b.dx AS ex, b.dy AS ey, b.ox AS px, b.oy AS py FROM m a JOIN m b ON a.p_partkey = b.p_partkey AND b.i = (a.i + 2) % 4 + 1)"""


@query(
    f"""WITH {_edges()} SELECT p_partkey, (i - 1)::INT AS corner,
    round((CASE WHEN abs(cr) < 1e-6 THEN x + 0.5::DOUBLE * away * (px + ox) ELSE sx + ex * ((mx - sx) * dy - (my - sy) * dx) / cr END)::FLOAT::DOUBLE, 3) AS x,
    round((CASE WHEN abs(cr) < 1e-6 THEN y + 0.5::DOUBLE * away * (py + oy) ELSE sy + ey * ((mx - sx) * dy - (my - sy) * dx) / cr END)::FLOAT::DOUBLE, 3) AS y FROM c"""
)
def unclip(spark, sf_dir):
    done = quads(spark, sf_dir).select("p_partkey", F.posexplode(op.unclip(F.col("quad"), 1.5)).alias("corner", "p"))
    return done.select("p_partkey", "corner", F.round(F.col("p.x").cast("double"), 3).alias("x"), F.round(F.col("p.y").cast("double"), 3).alias("y"))


def maps(spark, sf_dir, data):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.lit(8).alias("h"), F.lit(8).alias("w"), data(F.col("embedding")).alias("data")))


@query("SELECT vec_id, round(avg(abs(embedding[8 * y + x + 1])::FLOAT::DOUBLE)::FLOAT::DOUBLE, 6) AS box_score FROM embeddings, range(1, 6) a(y), range(2, 8) b(x) GROUP BY vec_id")
def box_score(spark, sf_dir):
    rows = maps(spark, sf_dir, lambda e: F.transform(e, lambda v: F.abs(v))).toDF("vec_id", "prob")
    quad = F.array(*[F.struct(F.lit(x).cast("float").alias("x"), F.lit(y).cast("float").alias("y")) for x, y in ((2, 1), (7, 1), (7, 5), (2, 5))])
    return op.box_score(rows.withColumn("quad", quad)).select("vec_id", F.round(F.col("box_score").cast("double"), 6).alias("box_score"))


@query("SELECT p_partkey, y::INT AS y, x::INT AS x FROM part, range(0, 24) a(y), range(0, 32) b(x) WHERE x BETWEEN p_partkey % 20 AND p_partkey % 20 + p_size % 17 AND y BETWEEN p_partkey % 13 AND p_partkey % 13 + p_size % 11")
def fill_poly(spark, sf_dir):
    """Upright rectangles, partly outside a 32 x 24 image."""
    x0, y0 = F.col("p_partkey") % 20, F.col("p_partkey") % 13
    x1, y1 = x0 + F.col("p_size") % 17, y0 + F.col("p_size") % 11
    corner = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), rows=1 << 14)
    return op.fill_poly(part.select("p_partkey", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("points")), 32, 24)


def _clipped(w, h):
    """CTEs from lines l(key, i, x0, y0, x1, y1) to the parts p of them in a w x h image: first rows, then columns, the first end before the
    second, positions cut to whole numbers."""
    out, last = [], "l"
    for axis, other, top, wide in (("y", "x", h - 1, w - 1), ("x", "y", w - 1, h - 1)):
        keep = f"greatest({axis}0, {axis}1) >= 0 AND least({axis}0, {axis}1) <= {top} AND NOT ({other}0 = {other}1 AND {other}0 NOT BETWEEN 0 AND {wide})"
        out.append(f"{last}{axis} AS (SELECT * FROM {last} WHERE {keep})")
        last += axis
        for end in "01":
            p, to = f"{axis}{end}", f"(CASE WHEN {axis}{end} < 0 THEN 0 ELSE {top} END)"
            moved = f"{other}{end} + trunc((({to} - {p}) * ({other}1 - {other}0))::DOUBLE / ({axis}1 - {axis}0))::BIGINT"
            cut = f"{p} NOT BETWEEN 0 AND {top}"
            rest = [f"{v}{e}" for e in "01" for v in (axis, other) if e != end]
            out.append(f"{last}{end} AS (SELECT key, i, {', '.join(rest)}, CASE WHEN {cut} THEN {to} ELSE {p} END AS {p}, CASE WHEN {cut} THEN {moved} ELSE {other}{end} END AS {other}{end} FROM {last})")
            last += end
        out.append(f"{last}e AS (SELECT * FROM {last} WHERE greatest({other}0, {other}1) >= 0 AND least({other}0, {other}1) <= {wide})")
        last += "e"
    return ", ".join(out) + f", p AS (SELECT * FROM {last})"


#: Pixels of lines p inside an image: after k steps of the longer axis the shorter one has made ceil(k * short / long - 1 / 2).
_PIXELS_OF_LINES = """ld AS (SELECT key, i, CASE WHEN x1 < x0 THEN x1 ELSE x0 END AS xa, CASE WHEN x1 < x0 THEN y1 ELSE y0 END AS ya, abs(x1 - x0) AS dx, abs(y1 - y0) AS dy, CASE WHEN (y1 >= y0) = (x1 >= x0) OR y1 = y0 OR (x1 = x0 AND y1 > y0) THEN 1 ELSE -1 END AS down FROM p),
px AS (SELECT key, i, k, CASE WHEN dy > dx THEN xa + (2 * dx * k + dy - 1) // greatest(2 * dy, 1) ELSE xa + k END AS x, CASE WHEN dy > dx THEN ya + down * k ELSE ya + down * (CASE WHEN dx = 0 THEN k ELSE (2 * dy * k + dx - 1) // (2 * dx) END) END AS y
  FROM (SELECT *, unnest(range(greatest(dx, dy) + 1)) AS k FROM ld))"""
_CORNERS = f"{_Q}, n AS (SELECT p_partkey AS key, list_transform(quad, lambda v: struct_pack(x := trunc(v.x)::BIGINT, y := trunc(v.y)::BIGINT)) AS q FROM q), l AS (SELECT key, i, q[(i + 2) % 4 + 1].x AS x0, q[(i + 2) % 4 + 1].y AS y0, q[i].x AS x1, q[i].y AS y1 FROM n, range(1, 5) r(i))"


@query(
    f"""WITH {_CORNERS}, {_clipped(240, 160)}, {_PIXELS_OF_LINES},
    c AS (SELECT l.key, l.i, l.y0 AS ya, l.y1 AS yb, CASE WHEN p.key IS NULL THEN l.x0 ELSE p.x0 END AS ax, CASE WHEN p.key IS NULL OR p.y0 = p.y1 THEN l.y0 ELSE p.y0 END AS ay, CASE WHEN p.key IS NULL THEN l.x1 ELSE p.x1 END AS bx, CASE WHEN p.key IS NULL OR p.y0 = p.y1 THEN l.y1 ELSE p.y1 END AS by_ FROM l LEFT JOIN p ON l.key = p.key AND l.i = p.i WHERE l.y0 <> l.y1),
    e AS (SELECT *, sign(bx - ax)::BIGINT * sign(by_ - ay)::BIGINT * ((abs(bx - ax) << 16) // abs(by_ - ay)) AS step FROM c),
    f AS (SELECT key, i, least(ya, yb) AS top, greatest(ya, yb) AS bottom, step, ((CASE WHEN ya < yb THEN ax ELSE bx END) << 16) + (least(ya, yb) - (CASE WHEN ya < yb THEN ay ELSE by_ END)) * step AS x FROM e),
    rows_ AS (SELECT key, y, x + (y - top) * step AS x, row_number() OVER (PARTITION BY key, y ORDER BY x + (y - top) * step) AS n FROM (SELECT *, unnest(range(greatest(top, 0), least(bottom, 160))) AS y FROM f)),
    s AS (SELECT a.key, a.y, unnest(range(greatest((a.x + 65535) >> 16, 0), least(b.x >> 16, 239) + 1)) AS x FROM rows_ a JOIN rows_ b ON a.key = b.key AND a.y = b.y AND a.n % 2 = 1 AND b.n = a.n + 1)
    SELECT DISTINCT key AS p_partkey, y::INT AS y, x::INT AS x FROM (SELECT key, y, x FROM s UNION ALL SELECT key, y, x FROM px)"""
)
def fill_poly_quads(spark, sf_dir):
    """Slanted quads in every order of their corners, many of them partly outside the image."""
    return op.fill_poly(quads(spark, sf_dir).select("p_partkey", F.transform("quad", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y"))).alias("points")), 240, 160)


@query(f"WITH {_CORNERS}, {_clipped(240, 160)}, {_PIXELS_OF_LINES} SELECT key AS p_partkey, (i - 1)::INT AS edge, k::INT AS k, x::INT AS x, y::INT AS y FROM px")
def line_pixels(spark, sf_dir):
    """Pixels of each edge of the quads, in drawing order, cut to the image."""
    corner = F.transform("quad", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    rows = quads(spark, sf_dir).select("p_partkey", F.posexplode(F.transform(corner, lambda v, i: F.array(F.get(corner, (i + 3) % 4), v))).alias("edge", "ends"))
    return op.line_pixels(rows, 240, 160, "ends")


@query(
    f"""WITH RECURSIVE {_Q}, s AS (SELECT p_partkey, list_sort(list_transform(quad, lambda v, i: struct_pack(x := v.x, i := i, y := v.y))) AS p FROM q),
    c AS (SELECT p_partkey % 40 AS page, p_partkey AS idx, CASE WHEN p[2].y > p[1].y THEN p[1].x ELSE p[2].x END AS x, CASE WHEN p[2].y > p[1].y THEN p[1].y ELSE p[2].y END AS y FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, idx) AS n FROM c),
    o AS (
      SELECT page, n, [struct_pack(idx := idx, x := x, y := y)] AS done FROM n WHERE n = 1
      UNION ALL
      SELECT page, n, list_concat(list_append(done[1:stay], struct_pack(idx := idx, x := x, y := y)), done[stay + 1:]) FROM (
        SELECT o.page, n.n, n.idx, n.x, n.y, done, coalesce(list_max(list_filter(range(1, len(done) + 1), lambda k: NOT (abs(n.y - done[k].y) < 10 AND n.x < done[k].x))), 0) AS stay FROM o JOIN n ON n.page = o.page AND n.n = o.n + 1)
    )
    SELECT page, d.idx AS idx, (r - 1)::INT AS rank FROM (SELECT page, unnest(done) AS d, generate_subscripts(done, 1) AS r FROM (SELECT page, arg_max(done, n) AS done FROM o GROUP BY page))"""
)
def reading_order(spark, sf_dir):
    q = quads(spark, sf_dir).select(F.col("p_partkey") % 40, F.col("p_partkey"), op.order_corners(F.col("quad"))).toDF("page", "idx", "quad")
    return op.reading_order(q, ["page"])


# Cracks of 8 x 8 masks in a frame 10 wide; sides 0 to 3 are left, below, right, above. Walks begin at cracks to the left or right and end early
# where they meet one that a scan by rows finds before.
_OFF, _AHEAD = "[-1, 10, 1, -10][q % 4 + 1]", "[10, 1, -10, -1][q % 4 + 1]"
_BORDERS = f"""g AS (SELECT vec_id, list_transform(range(100), lambda p: p % 10 BETWEEN 1 AND 8 AND p // 10 BETWEEN 1 AND 8 AND coalesce(embedding[8 * (p // 10 - 1) + p % 10] > 0, FALSE)) AS m FROM embeddings),
nx AS MATERIALIZED (SELECT vec_id, list_transform(range(400), lambda q: CASE WHEN m[q // 4 + 1] AND NOT m[q // 4 + {_OFF} + 1] THEN
    CASE WHEN m[q // 4 + {_AHEAD} + {_OFF} + 1] THEN (q // 4 + {_AHEAD} + {_OFF}) * 4 + (q + 3) % 4 WHEN m[q // 4 + {_AHEAD} + 1] THEN (q // 4 + {_AHEAD}) * 4 + q % 4 ELSE q - q % 4 + (q + 1) % 4 END END) AS after_ FROM g),
seeds AS (SELECT vec_id, q::INT AS head, (CASE q % 4 WHEN 0 THEN q // 4 ELSE q // 4 + 1 END)::INT AS start, after_[q + 1]::INT AS cur FROM nx, range(400) r(q) WHERE q % 2 = 0 AND after_[q + 1] IS NOT NULL),
walk AS (
  SELECT vec_id, start, head, cur, [head // 4] AS path FROM seeds
  UNION ALL
  SELECT w.vec_id, start, head, after_[cur + 1]::INT, list_append(path, cur // 4) FROM walk w JOIN nx USING (vec_id)
  WHERE cur <> head AND (cur % 2 = 1 OR (CASE cur % 4 WHEN 0 THEN cur // 4 ELSE cur // 4 + 1 END) > start)
),
whole AS (SELECT vec_id, start, path, len(path) AS n FROM walk WHERE cur = head),
runs AS (SELECT vec_id, start, CASE WHEN len(list_distinct(path)) = 1 THEN path[1:1] ELSE list_filter(path, lambda v, i: v <> path[i % n + 1]) END AS p FROM whole),
ends AS (SELECT vec_id, start, CASE WHEN len(p) = 1 THEN p ELSE list_filter(p, lambda v, i: p[i % len(p) + 1] - v <> v - p[(i + len(p) - 2) % len(p) + 1]) END AS p FROM runs)"""


@query(
    f"""WITH RECURSIVE {_BORDERS} SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY start DESC) - 1)::INT AS idx,
    array_to_string(list_transform(p, lambda v: (v % 10 - 1) || ':' || (v // 10 - 1)), ' ') AS points FROM ends"""
)
def find_contours(spark, sf_dir):
    rows = maps(spark, sf_dir, lambda e: F.transform(e, lambda v: F.when(v > 0, 1.0).otherwise(0.0).cast("float"))).toDF("vec_id", "mask")
    done = op.find_contours(rows)
    return done.select("vec_id", "idx", F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))), " ").alias("points"))


# Edges of hulls are pairs of points with all others to one side; their order is by direction from the leftmost point on.
_RECTS = f"""{_Q}, v AS (SELECT DISTINCT p_partkey, w.x::DOUBLE AS x, w.y::DOUBLE AS y FROM (SELECT p_partkey, unnest(quad) AS w FROM q)),
he AS (SELECT a.p_partkey, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len FROM v a JOIN v b ON a.p_partkey = b.p_partkey AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.p_partkey = a.p_partkey AND ((b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) < 0 OR ((b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) = 0 AND ((o.x - b.x) * (b.x - a.x) + (o.y - b.y) * (b.y - a.y) > 0 OR (o.x - a.x) * (b.x - a.x) + (o.y - a.y) * (b.y - a.y) < 0))))),
pr AS (SELECT h.p_partkey, dx / len AS ux, dy / len AS uy, CASE WHEN atan2(dy, dx) <= -pi() / 2 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END AS turn, min(v.x * (dx / len) + v.y * (dy / len)) AS a0, max(v.x * (dx / len) + v.y * (dy / len)) AS a1, min(v.y * (dx / len) - v.x * (dy / len)) AS b0, max(v.y * (dx / len) - v.x * (dy / len)) AS b1 FROM he h JOIN v USING (p_partkey) GROUP BY ALL),
best AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY ((a1 - a0) * (b1 - b0))::FLOAT, turn DESC) = 1),
rc AS (SELECT p_partkey, (a1 - a0)::FLOAT AS width, (b1 - b0)::FLOAT AS height, list_sort([struct_pack(x := (c.a * ux - c.b * uy)::FLOAT, i := c.i, y := (c.a * uy + c.b * ux)::FLOAT) FOR c IN [struct_pack(i := 0, a := a0, b := b0), struct_pack(i := 1, a := a1, b := b0), struct_pack(i := 2, a := a1, b := b1), struct_pack(i := 3, a := a0, b := b1)]]) AS p FROM best),
oc AS (SELECT p_partkey, width, height, CASE WHEN p[2].y > p[1].y THEN [p[1], p[2]] ELSE [p[2], p[1]] END AS l, CASE WHEN p[4].y > p[3].y THEN [p[3], p[4]] ELSE [p[4], p[3]] END AS r FROM rc)"""


@query(
    f"""WITH {_RECTS} SELECT p_partkey, round(l[1].x, 2) AS x0, round(l[1].y, 2) AS y0, round(r[1].x, 2) AS x1, round(r[1].y, 2) AS y1, round(r[2].x, 2) AS x2, round(r[2].y, 2) AS y2, round(l[2].x, 2) AS x3, round(l[2].y, 2) AS y3,
    round(least(width, height), 3) AS short, round(greatest(width, height), 3) AS long FROM oc"""
)
def min_area_rect(spark, sf_dir):
    done = flat(op.min_area_rect(quads(spark, sf_dir), "quad"), F.col("corners"), "p_partkey", "width", "height")
    return done.select("p_partkey", *[F.round(f"{c}{i}", 2).alias(f"{c}{i}") for i in range(4) for c in "xy"], F.round(F.least("width", "height"), 3).alias("short"), F.round(F.greatest("width", "height"), 3).alias("long"))


@query(None)
def db_decode(spark, sf_dir):
    rows = maps(spark, sf_dir, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: F.get(e, F.floor(y / 4).cast("int") * 8 + F.floor(x / 4).cast("int"))))))
    rows = rows.toDF("vec_id", "p").select("vec_id", F.struct(F.lit(32).alias("h"), F.lit(32).alias("w"), F.col("p.data").alias("data")).alias("prob"), F.lit(128).alias("width"), F.lit(64).alias("height"))
    done = op.db_decode(rows, DbDecoder(threshold=0.05, box_threshold=0.08))
    return flat(done, F.col("quad"), "vec_id", "idx", F.round("score", 5).alias("score"))


@query(None)
def crop_text_line(spark, sf_dir):
    quad = F.array(*[F.struct((F.lit(x) + F.col("img_id") % 3).cast("float").alias("x"), (F.lit(y) + F.col("img_id") % 2).cast("float").alias("y")) for x, y in ((1, 2), (11, 3), (11, 8), (1, 7))])
    done = op.crop_text_lines(images(spark, sf_dir).withColumn("quad", quad))
    return done.select("img_id", "line.width", "line.height", F.hex("line.data").alias("pixels"))

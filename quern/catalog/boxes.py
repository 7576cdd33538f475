"""Boxes of lineitem: an image per supplier, a box per line; detector heads; CTC."""

from pyspark.sql import functions as F

from ..functions import boxes as b
from ..operators.ctc import ctc_greedy
from ..operators.detect import BOX, Detector, nms, pairwise_iou, score_order, take_rows
from . import query, table

# Expressions for both engines.
BOXES = {
    "img_id": "l_suppkey",
    "idx": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1024 + CAST(l_quantity AS BIGINT) * 16 + CAST(floor(l_discount * 100 + 0.5) AS BIGINT)",
    "x1": "CAST((l_partkey * 37 + l_orderkey * 11) % 600 AS FLOAT)",
    "y1": "CAST((l_orderkey * 53 + l_linenumber * 7) % 440 AS FLOAT)",
    "w": "CAST(20 + l_quantity * 3 AS FLOAT)",
    "h": "CAST(10 + (l_partkey * 13) % 150 AS FLOAT)",
    "score": "CAST(((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 100003) / CAST(100003 AS DOUBLE) AS FLOAT)",
    "class": "l_linenumber",
}
_B = "b AS (SELECT img_id, idx, x1, y1, (x1 + w)::FLOAT AS x2, (y1 + h)::FLOAT AS y2, score, class FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in BOXES.items()) + " FROM lineitem))"


def lineitem_boxes(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in BOXES.items()])
    return raw.select("img_id", "idx", "x1", "y1", b.f32(F.col("x1") + F.col("w")).alias("x2"), b.f32(F.col("y1") + F.col("h")).alias("y2"), "score", "class")


def _converted(source, target):
    def run(spark, sf_dir):
        boxes = lineitem_boxes(spark, sf_dir)
        given = b.convert(BOX, "xyxy", source)
        named = boxes.select("img_id", "idx", *[c.alias(f"g{i}") for i, c in enumerate(given)])
        return named.select("img_id", "idx", *[c.alias(f"v{i}") for i, c in enumerate(b.convert(tuple(f"g{i}" for i in range(4)), source, target))])

    return run


_TO = {
    "xyxy": "x1 AS g0, y1 AS g1, x2 AS g2, y2 AS g3",
    "xywh": "x1 AS g0, y1 AS g1, (x2 - x1)::FLOAT AS g2, (y2 - y1)::FLOAT AS g3",
    "cxcywh": "((x1 + x2)::FLOAT * 0.5::FLOAT)::FLOAT AS g0, ((y1 + y2)::FLOAT * 0.5::FLOAT)::FLOAT AS g1, (x2 - x1)::FLOAT AS g2, (y2 - y1)::FLOAT AS g3",
}
_FROM = {
    "xyxy": "g0 AS x1, g1 AS y1, g2 AS x2, g3 AS y2",
    "xywh": "g0 AS x1, g1 AS y1, (g0 + g2)::FLOAT AS x2, (g1 + g3)::FLOAT AS y2",
    "cxcywh": "(g0 - (g2 * 0.5::FLOAT)::FLOAT)::FLOAT AS x1, (g1 - (g3 * 0.5::FLOAT)::FLOAT)::FLOAT AS y1, (g0 + (g2 * 0.5::FLOAT)::FLOAT)::FLOAT AS x2, (g1 + (g3 * 0.5::FLOAT)::FLOAT)::FLOAT AS y2",
}
for _s, _t in (("xyxy", "cxcywh"), ("cxcywh", "xyxy"), ("xywh", "cxcywh"), ("cxcywh", "xywh"), ("xyxy", "xywh"), ("xywh", "xyxy")):
    query(
        f"WITH {_B}, g AS (SELECT img_id, idx, {_TO[_s]} FROM b), c AS (SELECT img_id, idx, {_FROM[_s]} FROM g), d AS (SELECT img_id, idx, {_TO[_t]} FROM c) SELECT img_id, idx, g0 AS v0, g1 AS v1, g2 AS v2, g3 AS v3 FROM d",
        f"box_convert_{_s}_{_t}",
    )(_converted(_s, _t))


@query("SELECT l_suppkey AS img_id, count(*) AS boxes FROM lineitem GROUP BY l_suppkey")
def box_count(spark, sf_dir):
    return lineitem_boxes(spark, sf_dir).groupBy("img_id").agg(F.count("*").alias("boxes"))


@query(f"WITH {_B} SELECT img_id, idx, ((x2 - x1)::FLOAT * (y2 - y1)::FLOAT)::FLOAT AS area FROM b")
def box_area(spark, sf_dir):
    return lineitem_boxes(spark, sf_dir).select("img_id", "idx", b.area(BOX).alias("area"))


@query(f"WITH {_B} SELECT img_id, idx, least(greatest(x1, 0::FLOAT), 500::FLOAT) AS x1, least(greatest(y1, 0::FLOAT), 300::FLOAT) AS y1, least(greatest(x2, 0::FLOAT), 500::FLOAT) AS x2, least(greatest(y2, 0::FLOAT), 300::FLOAT) AS y2 FROM b")
def box_clip(spark, sf_dir):
    return lineitem_boxes(spark, sf_dir).select("img_id", "idx", *[c.alias(n) for c, n in zip(b.clip(BOX, 500, 300), BOX)])


@query(f"WITH {_B} SELECT img_id, idx, (x1 * 1.5::FLOAT)::FLOAT AS x1, (y1 * 0.3::FLOAT)::FLOAT AS y1, (x2 * 1.5::FLOAT)::FLOAT AS x2, (y2 * 0.3::FLOAT)::FLOAT AS y2 FROM b")
def box_scale(spark, sf_dir):
    return lineitem_boxes(spark, sf_dir).select("img_id", "idx", *[c.alias(n) for c, n in zip(b.scale(BOX, 1.5, 0.3), BOX)])


def _back(v, pad, top):
    return f"least(greatest((({v}::DOUBLE - {pad}) / gain)::FLOAT, 0::FLOAT), {top}::FLOAT)"


@query(
    f"WITH {_B}, o AS (SELECT *, (300 + (idx % 700))::DOUBLE AS ow, (200 + (img_id % 500))::DOUBLE AS oh FROM b), g AS (SELECT *, least(640.0::DOUBLE / ow, 480.0::DOUBLE / oh) AS gain FROM o), "
    "p AS (SELECT *, round_even((640 - ow * gain) / 2 - 0.1::DOUBLE, 0) AS l, round_even((480 - oh * gain) / 2 - 0.1::DOUBLE, 0) AS t FROM g) "
    f"SELECT img_id, idx, {_back('x1', 'l', 'ow')} AS x1, {_back('y1', 't', 'oh')} AS y1, {_back('x2', 'l', 'ow')} AS x2, {_back('y2', 't', 'oh')} AS y2 FROM p"
)
def unletterbox(spark, sf_dir):
    boxes = lineitem_boxes(spark, sf_dir)
    original = (300 + F.col("idx") % 700, 200 + F.col("img_id") % 500)
    return boxes.select("img_id", "idx", *[c.alias(n) for c, n in zip(b.unletterbox(BOX, (F.lit(640), F.lit(480)), original), BOX)])


def _iou(p, q):
    i = f"(greatest((least({p}.x2, {q}.x2) - greatest({p}.x1, {q}.x1))::FLOAT, 0::FLOAT) * greatest((least({p}.y2, {q}.y2) - greatest({p}.y1, {q}.y1))::FLOAT, 0::FLOAT))::FLOAT"
    area = lambda v: f"(({v}.x2 - {v}.x1)::FLOAT * ({v}.y2 - {v}.y1)::FLOAT)::FLOAT"
    return f"({i} / (({area(p)} + {area(q)})::FLOAT - {i})::FLOAT)::FLOAT"


@query(f"WITH {_B} SELECT p.img_id, p.class, p.idx AS a_idx, q.idx AS b_idx, {_iou('p', 'q')} AS iou FROM b p JOIN b q ON p.img_id = q.img_id AND p.class = q.class")
def box_iou(spark, sf_dir):
    """All pairs of an image and class, those without overlap too."""
    boxes = lineitem_boxes(spark, sf_dir)
    return pairwise_iou(boxes, boxes, ["img_id", "class"])


@query()
def box_iou_all(spark, sf_dir):
    """All pairs of an image, of any class and overlap. Without SQL, which takes long; tested against brute force."""
    boxes = lineitem_boxes(spark, sf_dir)
    return pairwise_iou(boxes, boxes, ["img_id"])


@query(f"WITH {_B} SELECT img_id, idx, score, (row_number() OVER (PARTITION BY img_id ORDER BY score DESC, idx) - 1)::INT AS rank FROM b", "score_order")
def score_order_query(spark, sf_dir):
    return score_order(lineitem_boxes(spark, sf_dir).select("img_id", "idx", "score"), ["img_id"])


@query(f"WITH {_B} SELECT * FROM (SELECT img_id, idx, score, (row_number() OVER (PARTITION BY img_id ORDER BY score DESC, idx) - 1)::INT AS rank FROM b WHERE score > 0.25::FLOAT) WHERE rank < 100")
def topk_candidates(spark, sf_dir):
    found = lineitem_boxes(spark, sf_dir).select("img_id", "idx", "score").filter(F.col("score") > b.f32(0.25))
    return score_order(found, ["img_id"]).filter("rank < 100")


@query(f"WITH {_B}, p AS (SELECT img_id AS at, min(idx) AS idx FROM b GROUP BY img_id) SELECT p.at, p.idx, b.img_id, b.x1, b.y1, b.x2, b.y2, b.score, b.class FROM p JOIN b ON p.idx = b.idx", "take_rows")
def take_rows_query(spark, sf_dir):
    boxes = lineitem_boxes(spark, sf_dir)
    return take_rows(boxes, boxes.groupBy(F.col("img_id").alias("at")).agg(F.min("idx").alias("idx")))


def _nms_sql(keys, threshold, source="b", extra=""):
    """Boxes of a group one after another by rank, with the list of those kept."""
    k = ", ".join(keys)
    same = " AND ".join(f"k.{x} = r.{x}" for x in keys)
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, idx) AS r FROM {source}),
    k AS (
      SELECT {k}, r, [struct_pack(idx := idx, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM r WHERE r = 1
      UNION ALL
      SELECT {", ".join("k." + x for x in keys)}, r.r, CASE WHEN len(list_filter(k.kept, lambda q: {_iou('q', 'r')} > {threshold}::FLOAT)) = 0
        THEN list_append(k.kept, struct_pack(idx := r.idx, x1 := r.x1, y1 := r.y1, x2 := r.x2, y2 := r.y2)) ELSE k.kept END
      FROM k JOIN r ON {same} AND r.r = k.r + 1
    ),
    s AS (SELECT {k}, unnest(list_transform(kept, lambda q: q.idx)) AS idx FROM (SELECT {k}, arg_max(kept, r) AS kept FROM k GROUP BY {k}))"""


_KEPT = "SELECT img_id, idx, x1, y1, x2, y2, score, class, (row_number() OVER (PARTITION BY img_id ORDER BY score DESC, idx) - 1)::INT AS rank FROM b SEMI JOIN s USING (img_id, idx)"


@query(f"WITH RECURSIVE {_B}, {_nms_sql(['img_id', 'class'], 0.45)} {_KEPT}")
def nms_per_class(spark, sf_dir):
    return nms(lineitem_boxes(spark, sf_dir), 0.45, ["img_id"], "class")


@query(f"WITH RECURSIVE {_B}, {_nms_sql(['img_id'], 0.45)} {_KEPT}")
def nms_agnostic(spark, sf_dir):
    return nms(lineitem_boxes(spark, sf_dir), 0.45, ["img_id"])


# Heads: the box of a line, and eight class scores made of keys.
_SCORES = ", ".join(f"CAST(((l_orderkey * {7919 + 2 * i} + l_partkey * {31 + i} + l_linenumber * {101 * i + 7}) % 100003) / CAST(100003 AS DOUBLE) AS FLOAT)" for i in range(4))
_HEADS = f"h AS (SELECT img_id, idx AS row, ((x1 + x2)::FLOAT * 0.5::FLOAT)::FLOAT AS b0, ((y1 + y2)::FLOAT * 0.5::FLOAT)::FLOAT AS b1, (x2 - x1)::FLOAT AS b2, (y2 - y1)::FLOAT AS b3, cs FROM (SELECT *, (x1 + w)::FLOAT AS x2, (y1 + h)::FLOAT AS y2 FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in BOXES.items())}, [{_SCORES}] AS cs FROM lineitem)))"


def heads(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in BOXES.items()], f"array({_SCORES}) AS class_scores")
    boxes = raw.withColumn("x2", b.f32(F.col("x1") + F.col("w"))).withColumn("y2", b.f32(F.col("y1") + F.col("h")))
    return boxes.select("img_id", F.col("idx").alias("row"), *[c.alias(f"b{i}") for i, c in enumerate(b.convert(BOX, "xyxy", "cxcywh"))], "class_scores")


def _detector_sql(candidates, keys):
    return f"""WITH RECURSIVE {_HEADS}, x AS (SELECT img_id, row, {_FROM['cxcywh'].replace('g0', 'b0').replace('g1', 'b1').replace('g2', 'b2').replace('g3', 'b3')}, cs FROM h),
    c AS ({candidates}),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY score DESC, row, class) AS idx FROM c WHERE score > 0.6::FLOAT) WHERE idx <= 400),
    {_nms_sql(keys, 0.45)}
    SELECT * FROM (SELECT img_id, (row_number() OVER (PARTITION BY img_id ORDER BY score DESC, idx) - 1)::INT AS rank, x1, y1, x2, y2, score, class, row AS index FROM b SEMI JOIN s USING (img_id, idx)) WHERE rank < 100"""


@query(_detector_sql("SELECT img_id, row, x1, y1, x2, y2, list_max(cs) AS score, (list_position(cs, list_max(cs)) - 1)::INT AS class FROM x", ["img_id", "class"]))
def detector_best_class(spark, sf_dir):
    return Detector(score_threshold=0.6, max_candidates=400, max_detections=100).detect(heads(spark, sf_dir), ["img_id"])


@query(_detector_sql("SELECT img_id, row, x1, y1, x2, y2, unnest(cs) AS score, (generate_subscripts(cs, 1) - 1)::INT AS class FROM x", ["img_id", "class"]))
def detector_multi_label(spark, sf_dir):
    return Detector(score_threshold=0.6, max_candidates=400, max_detections=100, multi_label=True).detect(heads(spark, sf_dir), ["img_id"])


@query(_detector_sql("SELECT img_id, row, x1, y1, x2, y2, list_max(cs) AS score, (list_position(cs, list_max(cs)) - 1)::INT AS class FROM x", ["img_id"]))
def detector_agnostic(spark, sf_dir):
    return Detector(score_threshold=0.6, max_candidates=400, max_detections=100, class_agnostic=True).detect(heads(spark, sf_dir), ["img_id"])


@query(
    """WITH s AS (SELECT vec_id, t::INT AS t, embedding[8 * t + 1 : 8 * t + 8] AS p FROM embeddings, range(8) r(t)),
    m AS (SELECT vec_id, t, (list_position(p, list_max(p)) - 1)::INT AS c, list_max(p) AS p FROM s),
    k AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM m),
    g AS (SELECT vec_id, list(c ORDER BY t) FILTER (WHERE c <> 0 AND c IS DISTINCT FROM before) AS ids, list(p ORDER BY t) FILTER (WHERE c <> 0 AND c IS DISTINCT FROM before) AS ps FROM k GROUP BY vec_id)
    SELECT vec_id, array_to_string(coalesce(ids, []), ' ') AS ids,
      CASE WHEN ids IS NULL THEN 0::FLOAT ELSE (list_reduce(ps, lambda a, b: (a + b)::FLOAT, 0::FLOAT) / len(ps)::FLOAT)::FLOAT END AS score FROM g""",
    "ctc_greedy",
)
def ctc_query(spark, sf_dir):
    steps = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"), "embedding").select("vec_id", "t", F.expr("slice(embedding, 8 * t + 1, 8)").alias("probs"))
    return ctc_greedy(steps, ["vec_id"]).select("vec_id", F.array_join(F.transform("ids", lambda v: v.cast("string")), " ").alias("ids"), "score")

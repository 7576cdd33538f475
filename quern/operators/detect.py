"""Non-maximum suppression and detector decoding over box tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import convert, f32, iou
from ..session import prepare

BOX = ("x1", "y1", "x2", "y2")


def score_order(boxes: DataFrame, group: list[str], score: str = "score", tie: str = "idx") -> DataFrame:
    """Rank from 0 by descending score, ties by position, per group."""
    return boxes.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))) - 1)


def pairwise_iou(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """(group, a_idx, b_idx, iou) for all pairs of a group: an equality join on the group.

    Both sides are dealt by group and merged: a table small enough to be sent to every task would leave all pairs to the few tasks
    that read the other. A row's pairs follow one another, group by group.
    """
    left, right = (t.select(*group, F.col("idx").alias(f"{n}_idx"), *[F.col(c).alias(f"{n}_{c}") for c in BOX]).hint("merge") for n, t in (("a", a), ("b", b)))
    corners = [tuple(f"{n}_{c}" for c in BOX) for n in "ab"]
    return left.join(right, group).select(*group, "a_idx", "b_idx", iou(*corners).alias("iou"))


def take_rows(rows: DataFrame, picks: DataFrame, pos: str = "idx") -> DataFrame:
    """Rows by a list of positions (at, idx): a join on the position that keeps the list's order in `at`."""
    return picks.join(rows, pos)


def suppress(x: np.ndarray, threshold: float) -> np.ndarray:
    """Positions kept of boxes in rank order: a box goes if a kept one before it overlaps by more than the threshold.

    Each kept box strikes the rest at once; a ratio of 0 / 0 never strikes.
    """
    x = x.astype(np.float32)
    sizes = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    left = np.arange(len(x))
    kept = []
    limit = np.float32(threshold)
    while len(left):
        i, left = left[0], left[1:]
        kept.append(i)
        w = np.maximum(np.minimum(x[i, 2], x[left, 2]) - np.maximum(x[i, 0], x[left, 0]), np.float32(0))
        h = np.maximum(np.minimum(x[i, 3], x[left, 3]) - np.maximum(x[i, 1], x[left, 1]), np.float32(0))
        common = w * h
        with np.errstate(divide="ignore", invalid="ignore"):
            left = left[~(common / (sizes[i] + sizes[left] - common) > limit)]
    return np.array(kept, np.int64)


def nms(boxes: DataFrame, threshold: float, group: list[str], class_col: str | None = None) -> DataFrame:
    """The rows that stay, with their rank in the group (descending score, ties by idx).

    Boxes of different classes never strike each other, so with a class column each (group, class) is an independent
    task; without one each group is.
    """
    prepare(boxes.sparkSession)
    keys = [*group, class_col] if class_col else list(group)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema)

    def run(t: pa.Table) -> pa.Table:
        score, idx = t["score"].to_numpy(), t["idx"].to_numpy()
        order = np.lexsort((idx, -score, ~np.isnan(score)))
        x = np.column_stack([t[c].to_numpy() for c in BOX])[order]
        return t.take(pa.array(np.sort(order[suppress(x, threshold)])))

    return score_order(boxes.groupBy(*keys).applyInArrow(run, schema), group)


@dataclass(frozen=True)
class Detector:
    """Decoding of detector heads: best class (or all classes), score filter, top candidates, suppression, top detections."""

    box_format: str = "cxcywh"
    score_threshold: float = 0.25
    iou_threshold: float = 0.45
    class_agnostic: bool = False
    multi_label: bool = False
    max_candidates: int = 30000
    max_detections: int = 300

    def detect(self, heads: DataFrame, group: list[str], boxes: tuple = ("b0", "b1", "b2", "b3"), row: str = "row", scores: str = "class_scores") -> DataFrame:
        """(group, rank, x1..y2, score, class, index) from rows of a box and an array of class scores.

        Filters and the candidate limit come before suppression; the limit is a grouped limit of the sort.
        """
        xyxy = [c.alias(n) for c, n in zip(convert(boxes, self.box_format, "xyxy"), BOX)]
        limit = f32(self.score_threshold)
        if self.multi_label:
            found = heads.select(*group, F.col(row).alias("index"), *xyxy, F.posexplode(scores).alias("class", "score"))
        else:
            best = F.array_max(F.transform(F.col(scores), lambda v: F.when(F.isnan(v), f32(float("-inf"))).otherwise(v)))
            found = heads.select(*group, F.col(row).alias("index"), *xyxy, best.alias("score"), F.col(scores).alias("_all"))
            found = found.withColumn("class", (F.array_position("_all", F.col("score")) - 1).cast("int")).drop("_all")
        found = found.filter((F.col("score") > limit) & ~F.isnan("score"))
        order = Window.partitionBy(*group).orderBy(F.col("score").desc(), "index", "class")
        top = found.withColumn("idx", F.row_number().over(order).cast("long")).filter(F.col("idx") <= self.max_candidates)
        kept = nms(top, self.iou_threshold, group, None if self.class_agnostic else "class")
        return kept.filter(F.col("rank") < self.max_detections).select(*group, F.col("rank").cast("int").alias("rank"), *BOX, "score", "class", "index")

"""Greedy CTC decoding of per-step probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import f32


def best_class(probs) -> Column:
    """Position of the first largest probability; NaN never wins and a row of NaN is class 0."""
    clean = F.transform(probs, lambda v: F.when(F.isnan(v), f32(float("-inf"))).otherwise(v))
    return (F.array_position(clean, F.array_max(clean)) - 1).cast("int")


def ctc_greedy(steps: DataFrame, key: list[str], t: str = "t", probs: str = "probs") -> DataFrame:
    """(key, ids, score): per sequence the best class of each step, repeats merged, blanks (0) dropped, and the mean
    probability of what stays, summed in order in single precision (0 if nothing stays)."""
    best = steps.select(*key, F.col(t).alias("t"), best_class(F.col(probs)).alias("c"), F.col(probs).alias("p"))
    best = best.withColumn("p", F.get("p", F.col("c"))).withColumn("before", F.lag("c").over(Window.partitionBy(*key).orderBy("t")))
    kept = best.withColumn("keep", (F.col("c") != 0) & ~F.col("c").eqNullSafe(F.col("before")))
    rows = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("t", "c", "p")))).alias("x"))
    total = F.aggregate("x", f32(0.0), lambda s, v: f32(s + v["p"]))
    return rows.select(*key, F.transform("x", lambda v: v["c"]).alias("ids"), F.when(F.size("x") == 0, f32(0.0)).otherwise(f32(total / F.when(F.size("x") > 0, F.size("x")))).alias("score"))

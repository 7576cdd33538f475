"""Waveform expressions over arrays of floats, and mel scales."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.audio import MelSpectrogram, WaveformProcessor
from .geometry import let


def duration_secs(samples, rate) -> Column:
    return F.size(samples).cast("double") / rate.cast("double")


def pad_or_truncate(samples, n: int, value: float = 0.0) -> Column:
    return F.slice(F.concat(samples, F.array_repeat(F.lit(value).cast("float"), n)), 1, n)


def normalized(samples) -> Column:
    """Zero mean and unit variance (of the population, plus 1e-7) over the whole clip, in double, kept in single precision.

    Mean and variance are bound before the elements are visited: inside the last lambda they would be computed for each.
    """
    n = F.size(samples).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.when(n > 0, n)

    def scaled(doubles, mean):
        return let(total(F.transform(doubles, lambda v: (v - mean) * (v - mean))), lambda variance: F.transform(doubles, lambda v: ((v - mean) / F.sqrt(variance + 1e-7)).cast("float")))

    return let(F.transform(samples, lambda v: v.cast("double")), lambda doubles: let(total(doubles), lambda mean: scaled(doubles, mean)))


def waveform(samples, rate, plan: WaveformProcessor) -> tuple[Column, Column]:
    """(values, mask): normalised before padding or cutting. A clip of another rate raises when it is read."""
    right = F.when(rate == plan.sample_rate, samples).otherwise(F.raise_error(F.concat(F.lit(f"expected {plan.sample_rate} Hz, got "), rate.cast("string"))))
    values = normalized(right) if plan.normalize else F.transform(right, lambda v: v.cast("float"))
    if plan.length is None:
        return values, F.transform(samples, lambda v: F.lit(1).cast("long"))
    mask = F.transform(F.sequence(F.lit(1), F.lit(plan.length)), lambda i: F.when(i <= F.size(samples), 1).otherwise(0).cast("long"))
    return pad_or_truncate(values, plan.length, plan.padding_value), mask


def hz_to_mel(f: Column, scale: str) -> Column:
    f = f.cast("double")
    if scale == "htk":
        return 2595.0 * F.log10(1.0 + f / 700.0)
    if scale == "kaldi":
        return 1127.0 * F.log(1.0 + f / 700.0)
    return F.when(f < 1000.0, 3.0 * f / 200.0).otherwise(15.0 + F.log(f / 1000.0) * (27.0 / math.log(6.4)))


def mel_to_hz(m: Column, scale: str) -> Column:
    m = m.cast("double")
    if scale == "htk":
        return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1.0)
    if scale == "kaldi":
        return 700.0 * (F.exp(m / 1127.0) - 1.0)
    return F.when(m < 15.0, 200.0 * m / 3.0).otherwise(1000.0 * F.exp((m - 15.0) * (math.log(6.4) / 27.0)))


def linspace(a: Column, b: Column, n: int) -> Column:
    """Array of n points; the last is b itself."""
    if n == 1:
        return F.array(a)
    step = (b - a) / (n - 1)
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: i.cast("double") * step + a), F.array(b))


def filter_bank(spark, p: MelSpectrogram) -> DataFrame:
    """(bin, mel, w): the triangles as rows, zeros left out. A table of fixed size for given parameters."""
    one = spark.range(1).select(
        F.transform(linspace(hz_to_mel(F.lit(p.f_min), p.scale), hz_to_mel(F.lit(p.f_max), p.scale), p.n_mels + 2), lambda m: mel_to_hz(m, p.scale)).alias("e"),
        linspace(F.lit(0.0), F.lit(float(p.sample_rate // 2)), p.n_fft // 2 + 1).alias("f"),
    )
    rows = one.select("e", F.posexplode("f").alias("bin", "hz")).select("e", "bin", "hz", F.explode(F.sequence(F.lit(0), F.lit(p.n_mels - 1))).alias("mel"))
    e = lambda k: F.get("e", F.col("mel") + k)
    w = F.greatest(F.lit(0.0), F.least((F.col("hz") - e(0)) / (e(1) - e(0)), (e(2) - F.col("hz")) / (e(2) - e(1))))
    if p.slaney_norm:
        w = w * (2.0 / (e(2) - e(0)))
    return rows.select("bin", "mel", w.alias("w")).filter("w > 0")


def frames(df: DataFrame, key: list[str], samples: str, p: MelSpectrogram) -> DataFrame:
    """(key, frame, values): overlapping windows of n_fft samples, hop_length apart, mirrored at the ends if centred."""
    x, n, pad = F.col(samples), F.size(samples), p.n_fft // 2
    if p.center:
        front = F.transform(F.sequence(F.lit(pad), F.lit(1)), lambda i: F.get(x, F.least(i, n - 1)))
        back = F.transform(F.sequence(F.lit(0), F.lit(pad - 1)), lambda i: F.get(x, F.greatest(n - 2 - i, F.lit(0))))
        x = F.concat(front, x, back)
    padded = df.filter(n > 0).select(*key, x.alias("_x")).filter(F.size("_x") >= p.n_fft)
    starts = F.sequence(F.lit(0), F.size("_x") - p.n_fft, F.lit(p.hop_length))
    return padded.select(*key, "_x", F.posexplode(starts).alias("frame", "_s")).select(*key, "frame", F.slice("_x", F.col("_s") + 1, p.n_fft).alias("values"))

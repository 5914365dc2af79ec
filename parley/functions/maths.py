"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: stands for an infinite ratio in strict JSON.
INFINITE_DB = 200.0


def decibels(num: Column, den: Column) -> Column:
    return F.lit(10.0) * F.log10(num / den)


def erle_db(mic_energy: Column, clean_energy: Column) -> Column:
    """Echo return loss enhancement with finite values for silent inputs."""
    return (
        F.when(clean_energy <= 0, F.when(mic_energy > 0, INFINITE_DB).otherwise(0.0))
        .when(mic_energy <= 0, 0.0)
        .otherwise(decibels(mic_energy, clean_energy))
    )


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def in_range_or(x: Column, low, high, fallback) -> Column:
    return F.when(x.between(low, high), x).otherwise(fallback)


def finite_nonnegative(x: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(x, F.lit(0.0)))


def backoff(attempts: Column, base: int, cap: int) -> Column:
    """``min(cap, base * 2^(attempts-1))`` seconds without overflow."""
    steps = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(62))
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), steps)).cast("long")


def to_int16(x: Column) -> Column:
    v = clamp(x.cast("double"), F.lit(-1.0), F.lit(1.0)) * 32767
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("int")


def energy(samples: Column) -> Column:
    """Sum of squares of an array."""
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two equally long arrays."""
    return F.aggregate(
        F.arrays_zip(a.alias("a"), b.alias("b")),
        F.lit(0.0),
        lambda s, x: s + x["a"].cast("double") * x["b"].cast("double"),
    )


def mean_of(samples: Column, offset: int, count: int) -> Column:
    """Mean over a range of channels of one frame; 0 when the range is empty."""
    part = F.slice(samples, offset + 1, max(count, 0))
    n = F.size(part)
    return F.when(n > 0, F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double")) / n).otherwise(0.0)


def real_time_factor(audio_secs: Column, wall_secs: Column) -> Column:
    return F.when(wall_secs > 0, audio_secs / wall_secs).otherwise(0.0)

"""Columns for break detection and agreement (PRJ-22…25, 28, 30; FLT-17, 18)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def raw_label(delta: Column, threshold: float) -> Column:
    """PRJ-22: by the size of the level change. Rising is land to water."""
    return F.when(delta >= threshold, "L→W").when(delta <= -threshold, "W→L").otherwise("weak/unclear")


def final_label(passed: Column, delta: Column) -> Column:
    """PRJ-23, T23: by sign if quality control passes; not positive, and missing, are W→L."""
    return F.when(passed, F.when(F.coalesce(delta > 0, F.lit(False)), "L→W").otherwise("W→L")).otherwise("weak/unclear")


def lwz(rss: Column, m: Column, n: Column, params: int, scale: Column | float = 1.0) -> Column:
    """PRJ-24: Liu, Wu and Zidek's criterion of a model with m breaks."""
    return n * F.ln(F.greatest(rss, F.lit(1e-12)) / n) + scale * 0.299 * F.pow(F.ln(n), 2.1) * (m + 1) * params


def bic(rss: Column, m: Column, n: Column, params: int, scale: Column | float = 1.0) -> Column:
    """PRJ-24: the Bayesian criterion of a model with m breaks."""
    return n * F.ln(F.greatest(rss, F.lit(1e-12)) / n) + scale * (m + 1) * params * F.ln(n)


def penalty(scale: Column, variance: Column, smooth_variance: Column, n: Column) -> Column:
    """PRJ-28, T17: scale * variance * ln n; the smoothed variance where the other is 0 or not finite."""
    usable = F.coalesce((variance > 0) & ~F.isnan(variance) & (variance < float("inf")), F.lit(False))
    return scale * F.when(usable, variance).otherwise(smooth_variance) * F.ln(n)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """PRJ-25: bounds of a share k / n; NULL for n = 0."""
    p = F.try_divide(k, n)
    den = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / den
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / den
    return centre - half, centre + half


def inside_edges(index: Column, length: Column, guard: int) -> Column:
    """FLT-17: guard places from either end."""
    return index.between(guard, length - 1 - guard)


def quality(delta: Column, twsv: Column, slope_change: Column, delta_min: float, twsv_min: float, slope_min: float, rule: str = "all") -> Column:
    """FLT-18, T12: rule "all" asks for delta, variance gain and slope; "twsv_and_any" for the gain and one of the others."""
    level = F.coalesce(F.abs(delta) >= delta_min, F.lit(False))
    gain = F.coalesce(twsv >= twsv_min, F.lit(False))
    slope = F.coalesce(F.abs(slope_change) >= slope_min, F.lit(False))
    if rule == "all":
        return level & gain & slope
    if rule == "twsv_and_any":
        return gain & (level | slope)
    raise ValueError(f"unknown rule {rule!r}")


def joined_dates(times: Column) -> Column:
    """PRJ-30: an array of times as ISO dates with ; between."""
    return F.array_join(F.transform(times, lambda t: F.date_format(t, "yyyy-MM-dd")), ";")

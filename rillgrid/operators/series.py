"""Ordered series (WIN-1…9, PRJ-19, 20): one shuffle by series, then windows over tens of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _by(series: str, ts: str):
    return Window.partitionBy(series).orderBy(ts)


def rolling_median3(series: str = "series", ts: str = "ts", v: str = "v") -> Column:
    """WIN-1, T25: centred median of three rows, of those there are: it fills isolated gaps.

    By lag, lead and least/greatest, which skip NULL, in place of a sorting percentile.
    """
    w = _by(series, ts)
    a, b, c = F.lag(v).over(w), F.col(v), F.lead(v).over(w)
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (b, c)), F.when(a.isNotNull(), 1).otherwise(0))
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return F.when(n == 3, middle).when(n == 2, (low + high) / 2).otherwise(low)


def interpolated(series: str = "series", ts: str = "ts", v: str = "v") -> Column:
    """WIN-2, 3, T26: linear in time between neighbours, the nearest value at the ends."""
    w = _by(series, ts)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(v).isNotNull(), F.struct(F.col(ts).cast("timestamp").alias("t"), F.col(v).alias("v")))
    past, future = F.last(point, ignorenulls=True).over(back), F.first(point, ignorenulls=True).over(ahead)
    at, t0, t1 = (F.unix_micros(x) for x in (F.col(ts).cast("timestamp"), past["t"], future["t"]))
    line = past["v"] + (future["v"] - past["v"]) * (at - t0) / (t1 - t0)
    return F.when(F.col(v).isNotNull(), F.col(v)).when(past.isNotNull() & future.isNotNull(), line).otherwise(F.coalesce(past["v"], future["v"]))


def mean_filled(series: str = "series", v: str = "v") -> Column:
    """WIN-4: what is still missing becomes the series' mean."""
    return F.coalesce(v, F.avg(v).over(Window.partitionBy(series)))


def zscore(series: str = "series", v: str = "v", eps: float = 1e-9) -> Column:
    """PRJ-19, T24, T27: per series, population deviation plus eps."""
    w = Window.partitionBy(series)
    return (F.col(v) - F.avg(v).over(w)) / (F.stddev_pop(v).over(w) + eps)


def position(series: str = "series", ts: str = "ts") -> Column:
    """WIN-5: 0, 1, … within the series."""
    return F.row_number().over(_by(series, ts)) - 1


def compressed_position(series: str = "series", ts: str = "ts", v: str = "v") -> Column:
    """WIN-6: position among the rows with a value; NULL without one."""
    return F.when(F.col(v).isNotNull(), F.count(v).over(_by(series, ts).rowsBetween(Window.unboundedPreceding, 0)) - 1)


def prepared(long: DataFrame, series: str = "series", ts: str = "ts", v: str = "v", scale: bool = True) -> DataFrame:
    """A6: median, interpolation, ends, mean and z-score in turn; the windows share one shuffle."""
    out = long.withColumn(v, rolling_median3(series, ts, v)).withColumn(v, interpolated(series, ts, v)).withColumn(v, mean_filled(series, v))
    return out.withColumn(v, zscore(series, v)) if scale else out


def vectors(long: DataFrame, series: str = "series", ts: str = "ts", v: str = "v") -> DataFrame:
    """(series, ts array, v array), in time order; missing values as NULL elements."""
    held = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(v).alias("v"))))
    return long.groupBy(series).agg(held.alias("p")).select(series, F.col("p.t").alias("t"), F.col("p.v").alias("v"))

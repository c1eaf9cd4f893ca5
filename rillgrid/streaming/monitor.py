"""Streaming occurrence counts and level-change alerts per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_occurrence(events: DataFrame, threshold: float = 0.6, window: str = "1 day", late: str = "2 days", series: str = "series", ts: str = "ts", v: str = "v") -> DataFrame:
    """Share of values above threshold in each series and window; rows later than the watermark are dropped, so state stays bounded."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    wet = F.avg(F.when((F.col(v) > threshold) & ~F.isnan(v), 1.0).otherwise(0.0))
    return timed.groupBy(F.window(ts, window), series).agg(F.count("*").alias("n"), wet.alias("occ")).select(series, F.col("window.start").alias("start"), "n", "occ")


def level_changes(events: DataFrame, threshold: float = 0.15, warmup: int = 5, series: str = "series", ts: str = "ts", v: str = "v") -> DataFrame:
    """Alerts where a value leaves the running mean of its series by threshold; the mean restarts there. State is three numbers a series."""
    kind = dict(events.dtypes)[series]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        out = []
        for row in pd.concat(list(frames)).dropna(subset=[v]).sort_values(ts).itertuples():
            x = float(getattr(row, v))
            if n >= warmup and abs(x - mean) >= threshold:
                out.append({series: key[0], "ts": getattr(row, ts), "mean": mean, "value": x})
                n, mean = 0, 0.0
            n += 1
            mean += (x - mean) / n
        state.update((n, mean))
        yield pd.DataFrame(out, columns=[series, "ts", "mean", "value"])

    timed = events.select(series, F.col(ts).cast("timestamp").alias(ts), v)
    return timed.groupBy(series).applyInPandasWithState(step, f"`{series}` {kind}, ts timestamp, mean double, value double", "n long, mean double", "append", GroupStateTimeout.NoTimeout)

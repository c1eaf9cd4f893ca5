"""Time stacks (row, col, ts, v): coverage, occurrence, masks, medians (AGG-4…7, 21; FLT-10…16; JN-7).

A stack may leave missing values out or hold them as NULL; the number of dates T is given,
or counted once. Sums over all T dates then need no dense grid and no join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rillgrid.operators.quantiles import quantiles

PIXEL = ("row", "col")
MOST_DATES = 100_000  # a time axis longer than this is not brought to the driver


def dates(stack: DataFrame, ts: str = "ts") -> list:
    """The sorted time axis; its length does not grow with the area."""
    found = stack.select(ts).where(F.col(ts).isNotNull()).distinct().orderBy(ts).limit(MOST_DATES + 1).collect()
    if len(found) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates")
    return [r[0] for r in found]


def dense(stack: DataFrame, key: Sequence[str] = PIXEL, ts: str = "ts", v: str = "v", axis: Sequence | None = None) -> DataFrame:
    """Every (pixel, date) once, v NULL where the stack has none: one shuffle by pixel, no cross join. Of repeated dates the largest value stays.

    Without a given axis the dates are one value that a subquery finds, so they are neither in the plan nor on the driver.
    """
    kind = stack.schema[ts].dataType
    held = stack.groupBy(*key, ts).agg(F.max(v).alias(v)).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.when(F.col(v).isNotNull() & F.col(ts).isNotNull(), F.struct(ts, v)))).alias("held"))
    if axis is None:
        every = F.array_sort(F.collect_set(ts))
        grid = stack.agg(F.when(F.size(every) > MOST_DATES, F.raise_error(F.lit(f"more than {MOST_DATES} dates"))).otherwise(every)).scalar()
    else:
        grid = F.array(*(F.lit(t).cast(kind) for t in axis)).cast(f"array<{kind.simpleString()}>")
    return held.withColumn("axis", grid).select(*key, "held", F.explode("axis").alias(ts)).select(*key, ts, F.try_element_at("held", F.col(ts)).alias(v))


def present(v: str = "v", nodata: float | None = None) -> Column:
    """T2: v with NaN and the nodata value as NULL."""
    x = F.when(F.isnan(v), None).otherwise(F.col(v))
    return x if nodata is None else F.nullif(x, F.lit(nodata))


def coverage(stack: DataFrame, T: int, key: Sequence[str] = PIXEL, v: str = "v") -> DataFrame:
    """AGG-4: share of the T dates with a value."""
    return stack.groupBy(*key).agg((F.count(v) / T).alias("coverage"))


def stable(stack: DataFrame, T: int, least: float = 0.6, key: Sequence[str] = PIXEL) -> DataFrame:
    """FLT-13: pixels covered on a share of least of the dates, with their coverage."""
    return coverage(stack, T, key).where(F.col("coverage") >= least)


def occurrence(stack: DataFrame, T: int, threshold: float = 0.6, key: Sequence[str] = PIXEL, v: str = "v") -> DataFrame:
    """AGG-6, T1: share of all T dates above threshold; missing dates count as below. NaN counts as missing."""
    return stack.groupBy(*key).agg((F.sum(F.when((F.col(v) > threshold) & ~F.isnan(v), 1.0).otherwise(0.0)) / T).alias("occ"))


def ever(occ: DataFrame, least: float = 0.01) -> DataFrame:
    """FLT-15: pixels that were wet at least that often."""
    return occ.where(F.col("occ") >= least)


def pure(stack: DataFrame, T: int, threshold: float = 0.85, ratio: float = 0.6, key: Sequence[str] = PIXEL, v: str = "v") -> DataFrame:
    """FLT-14, T10: pixels at threshold or above on int(ratio * T) dates or more."""
    return stack.groupBy(*key).agg(F.count_if(F.col(v) >= threshold).alias("hits")).where(F.col("hits") >= int(ratio * T))


def without_dates(stack: DataFrame, drop: Iterable[str], ts: str = "ts") -> DataFrame:
    """FLT-10: rows of these days (YYYYMMDD) go."""
    return stack.where(~F.date_format(ts, "yyyyMMdd").isin(*drop))


def blanked_dates(stack: DataFrame, blank: Iterable[str], ts: str = "ts", v: str = "v") -> DataFrame:
    """FLT-11: rows of these days (YYYY-MM-DD) stay, their values become NULL."""
    return stack.withColumn(v, F.when(~F.date_format(ts, "yyyy-MM-dd").isin(*blank), F.col(v)))


def within(stack: DataFrame, mask: DataFrame, key: Sequence[str] = PIXEL) -> DataFrame:
    """JN-7: rows of the pixels that the mask lists."""
    return stack.join(mask.select(*key).distinct(), list(key), "left_semi")


def masked(stack: DataFrame, mask: DataFrame, key: Sequence[str] = PIXEL, v: str = "v") -> DataFrame:
    """FLT-12: all rows; values outside the mask become NULL."""
    flag = mask.select(*key).distinct().withColumn("_in", F.lit(True))
    return stack.join(flag, list(key), "left").withColumn(v, F.when(F.col("_in"), F.col(v))).drop("_in")


def region_median(stack: DataFrame, ts: str = "ts", v: str = "v") -> DataFrame:
    """AGG-5: median over the pixels of each date; NULL for a date without values."""
    return quantiles(stack, [ts], [v], [0.5]).select(ts, F.col(v)[0].alias("median"))


def mask_if_exists(spark, path: str, like: dict, tolerance: float = 1e-6) -> DataFrame | None:
    """SRC-14: the mask table at path (row, col of its pixels), or None if there is none.

    like: height, width, crs and transform of the stack. The mask's own, a row of the table path + ".meta", must agree.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    own = spark.read.parquet(f"{path}.meta").first()
    for name in ("height", "width", "crs"):
        if own[name] != like[name]:
            raise ValueError(f"the mask's {name} is {own[name]}, the stack's {like[name]}")
    if any(abs(a - b) > tolerance for a, b in zip(own["transform"], like["transform"], strict=True)):
        raise ValueError("the mask's transform is not the stack's")
    return spark.read.parquet(path).where("m").select("row", "col")


def temporal_median(stack: DataFrame, components: Sequence[str], key: Sequence[str] = PIXEL) -> DataFrame:
    """AGG-7: median over the dates of each pixel, for each component."""
    return stack.groupBy(*key).agg(*(F.percentile(c, 0.5).alias(c) for c in components))


def same_profile(meta: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """SRC-14: one row (files, same) that says whether size, crs and transform agree over all files."""
    spread = F.greatest(*(F.max(F.col("transform")[i]) - F.min(F.col("transform")[i]) for i in range(6)))
    return meta.agg(F.count("*").alias("files"), ((F.count_distinct("crs", "height", "width") == 1) & (spread <= tolerance)).alias("same"))

"""Exact quantiles of large groups by counting passes (AGG-5, 9, 15; PRJ-6).

The q-quantile of n values lies between two order statistics. To find one, its group's values are
counted into bins between their least and largest; the bin that holds the wanted rank is
counted again alone, between the least and largest value in it, until it holds one value. A pass
is a partial aggregate: a task keeps a count, a least and a largest value for each bin of each
interval that is still open, whatever the number of rows, and no group's values ever meet. All
groups, columns and quantiles share their passes. Bins are of equal width where an interval's ends
have one sign and lie within a factor of BINS, and of equal ratio otherwise, so values of all
magnitudes take about log(n) / log(BINS) passes, seven at worst for one sign and magnitude.

Quantiles interpolate linearly between neighbours. NULL and NaN do not count; a group
without values keeps a row with NULL. Infinite values are outermost bins of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rillgrid.plans.session import written

BINS = 1024
PASSES = 200  # of which far fewer are needed; a loop that does not end is an error
BROADCAST_ROWS = 50_000  # open intervals of some 120 bytes; beyond that the join shuffles
_KEY = ["g", "c"]


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin, 0 to bins - 1, of x between lo and hi; never falls as x grows. Infinite ends have bins of their own."""
    inside = F.lit(bins - 3)
    wide = (F.signum(lo) != F.signum(hi)) | (F.greatest(F.abs(lo), F.abs(hi)) > bins * F.least(F.abs(lo), F.abs(hi)))
    # Halves where the difference of two finite doubles may be infinite, but not where half of one may be 0.
    share = F.when(F.greatest(F.abs(lo), F.abs(hi)) < 1e300, F.try_divide(x - lo, hi - lo)).otherwise(F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2))
    # Equal ratios, on both sides of zero: the logarithm's place among those of all magnitudes of doubles.
    log = F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1076))
    log_lo, log_hi = (F.when(e == 0, 0.0).otherwise(F.signum(e) * (F.log2(F.abs(e)) + 1076)) for e in (lo, hi))
    place = F.when(wide, F.try_divide(log - log_lo, log_hi - log_lo)).otherwise(share)
    finite = F.least(F.floor(place * inside), inside - 1) + 1
    infinite = F.lit(float("inf"))
    return F.when(x == -infinite, 0).when(x == infinite, bins - 1).when(hi <= lo, 1).otherwise(F.greatest(finite, F.lit(1))).cast("int")


def _counted(values: DataFrame, open_: DataFrame, bins: int) -> DataFrame:
    """(g, c, lo, hi, bin, n, least, largest) of the values inside the open intervals (g, c, lo, hi)."""
    inf = F.lit(float("inf"))
    at = values.join(open_, _KEY).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    ends = F.greatest("lo", F.when(F.col("lo") == -inf, F.lit(-1.7976931348623157e308))), F.least("hi", F.when(F.col("hi") == inf, F.lit(1.7976931348623157e308)))
    return at.withColumn("bin", _bin(F.col("x"), *ends, bins)).groupBy(*_KEY, "lo", "hi", "bin").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("largest"))


def order_statistics(values: DataFrame, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """(g, c, rank, x): the values of the wanted ranks, from 0, of each (g, c) of values (g, c, x) without nulls.

    wanted: (g, c, rank, lo, hi), the group's least and largest value with each rank.
    """
    if bins < 8:
        raise ValueError("at least 8 bins are needed")
    open_, done = wanted.select(*_KEY, "rank", F.col("rank").alias("left"), "lo", "hi"), None
    for _ in range(PASSES):
        open_ = written(open_, "ranks")
        ready = open_.where("lo = hi").select(*_KEY, "rank", F.col("lo").alias("x"))
        done = ready if done is None else done.unionByName(ready)
        open_ = open_.where("lo < hi")
        n = open_.count()
        if not n:
            return done
        intervals = open_.select(*_KEY, "lo", "hi").distinct()
        counts = _counted(values, F.broadcast(intervals) if n <= BROADCAST_ROWS else intervals, bins)
        # At most bins rows for an interval: their running counts are an array's, in the interval's own row.
        row = counts.groupBy(*_KEY, "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "least", "largest"))).alias("b"))
        hit = F.aggregate(
            "b", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("double").alias("l"), F.lit(None).cast("double").alias("h")),
            lambda s, b: F.when((s["before"].isNull()) & (F.col("left") < s["seen"] + b["n"]), F.struct((s["seen"] + b["n"]).alias("seen"), s["seen"].alias("before"), b["least"].alias("l"), b["largest"].alias("h")))
            .otherwise(F.struct((s["seen"] + b["n"]).alias("seen"), s["before"].alias("before"), s["l"].alias("l"), s["h"].alias("h"))),
        )
        open_ = open_.join(row, [*_KEY, "lo", "hi"]).select(*_KEY, "rank", "left", hit.alias("s")).select(*_KEY, "rank", (F.col("left") - F.col("s.before")).alias("left"), F.col("s.l").alias("lo"), F.col("s.h").alias("hi"))
    raise RuntimeError(f"ranks were not settled in {PASSES} passes")


def quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """by, and for each column an array of its exact quantiles in the order of shares (NULL without values), a row for each group."""
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    keys = F.struct(*(F.col(c) for c in by)) if by else F.lit(1)
    pairs = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)))
    # One narrow table, since each pass reads it; -0.0 is 0.0, so that equal values are one.
    long = written(df.select(keys.alias("g"), F.explode(pairs).alias("e")).select("g", "e.c", (F.col("e.x") + 0.0).alias("x")), "values")
    x = F.when(~F.isnan("x"), F.col("x"))
    ends = written(long.groupBy(*_KEY).agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")), "ends")
    place = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    below = [F.floor(place(s)).cast("long") for s in shares]
    ranks = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(b, F.least(b + 1, F.col("n") - 1)) for b in below)))))
    found = order_statistics(long.where("x IS NOT NULL AND NOT isnan(x)"), ends.where("n > 0").select(*_KEY, ranks.alias("rank"), "lo", "hi"), bins)
    held = found.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("held"))

    def between(b: Column, s: float) -> Column:
        low, high, t = F.try_element_at("held", b), F.try_element_at("held", F.least(b + 1, F.col("n") - 1)), place(s) - b
        return F.when((t == 0) | (low == high), low).otherwise(low + (high - low) * t)

    each = ends.join(held, _KEY, "left").select(*_KEY, F.when(F.col("n") > 0, F.array(*(between(b, s) for b, s in zip(below, shares, strict=True)))).alias("q"))
    wide = each.groupBy("g").agg(*(F.max(F.when(F.col("c") == i, F.col("q"))).alias(f"q{i}") for i in range(len(columns))))
    return wide.select(*(F.col("g")[c].alias(c) for c in by), *(F.col(f"q{i}").alias(c) for i, c in enumerate(columns)))

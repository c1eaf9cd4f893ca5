"""Quality assurance and agreement (AGG-1, 8…18, 26; JN-1, 2, 5, 6, 9; PRJ-15, 16, 20, 35; FLT-1, 2, 8, 9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillgrid.functions import breaks, spectral
from rillgrid.operators.quantiles import quantiles
from rillgrid.plans.session import written

SENTINEL = -9999.0


def shift_statistics(tiepoints: DataFrame, scene: str = "scene", least: float = 10.0, reference: object = None) -> DataFrame:
    """AGG-1, FLT-1, 2: mean shifts, RMSE and number of the reliable tie points of each scene but the reference."""
    good = (F.col("dx") != SENTINEL) & (F.col("dy") != SENTINEL) & (F.col("rel") >= least)
    rows = tiepoints.where(good)
    rows = rows if reference is None else rows.where(F.col(scene) != reference)
    return rows.groupBy(scene).agg(F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"), F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("rmse"), F.count("*").alias("num_points"))


def correlation(x: str, y: str) -> Column:
    """AGG-8, T33: Pearson's r over rows with both values; NULL for constant or single input. Never corr(), which raises on constants."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    deviation = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(deviation > 0, deviation))


def base_scene(scenes: DataFrame, name: str, hint: str) -> object:
    """T36: the first name that contains the hint, else the first."""
    return scenes.agg(F.min_by(name, F.struct((~F.contains(F.col(name).cast("string"), F.lit(hint))).alias("k"), F.col(name).alias("n")))).first()[0]


def delta_qa(values: DataFrame, base: object, scene: str = "scene", key: Sequence[str] = ("row", "col"), abun: str = "abun", ndwi: str = "ndwi", d_abun: float = 0.20, d_ndwi: float = -0.05, min_valid: float = 0.2) -> DataFrame:
    """JN-6, PRJ-15, 16, FLT-8, 9, AGG-8, 9, T5: each scene against the base scene.

    The share of suspicious pixels is over valid ones; a scene with fewer valid pixels than min_valid of its own goes.
    """
    first = values.where(F.col(scene) == F.lit(base)).select(*key, F.col(abun).alias("abun0"), F.col(ndwi).alias("ndwi0"))
    pairs = values.where(F.col(scene) != F.lit(base)).join(first, list(key), "left")
    valid = F.col(abun).isNotNull() & F.col(ndwi).isNotNull() & F.col("abun0").isNotNull() & F.col("ndwi0").isNotNull()
    da, dn = F.when(valid, F.col(abun) - F.col("abun0")), F.when(valid, F.col(ndwi) - F.col("ndwi0"))
    rows = pairs.select(F.col(scene).alias("scene"), F.when(valid, F.col(abun)).alias("a"), F.when(valid, F.col(ndwi)).alias("n"), da.alias("da"), dn.alias("dn"))
    rows = written(rows, "pairs")
    suspicious = F.coalesce((F.col("da") > d_abun) & (F.col("dn") > d_ndwi), F.lit(False))
    out = rows.groupBy("scene").agg(
        F.count("*").alias("pixels"), F.count("da").alias("valid"), correlation("a", "n").alias("corr_abun_ndwi"),
        F.avg(F.when(F.col("da").isNotNull(), suspicious.cast("double"))).alias("suspicious_frac"),
    )
    q = quantiles(rows.withColumnRenamed("scene", "s"), ["s"], ["da", "dn"], [0.5, 0.95])
    both = out.where(F.col("valid") >= min_valid * F.col("pixels")).join(q, F.col("scene").eqNullSafe(F.col("s")), "left").withColumnRenamed("scene", scene)
    return both.select(scene, *out.columns[1:], F.col("da")[0].alias("delta_abun_median"), F.col("da")[1].alias("delta_abun_p95"), F.col("dn")[0].alias("delta_ndwi_median"))


def paired_by_prefix(left: DataFrame, right: DataFrame, name: str, image: str, length: int = 25) -> DataFrame:
    """JN-5, T35: each name with the image of the same name, else the first image that holds its first 25 characters anywhere, else NULL.

    An image is keyed by each of its runs of that length, so that holding is an equi join; a shorter name is not looked for within others.
    """
    key = F.substring(name, 1, length).alias("_p")
    one = left.select("*", key)
    runs = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(image) - length + 1)), lambda k: F.substring(F.col(image), k, F.lit(length))))).alias("_p")
    many = right.select(image, runs).groupBy("_p").agg(F.min(image).alias("_first"))
    exact = right.select(F.col(image).alias("_exact")).distinct()
    return one.join(many, "_p", "left").join(exact, F.col(name) == F.col("_exact"), "left").withColumn(image, F.coalesce("_exact", "_first")).drop("_p", "_first", "_exact")


def with_meta(rows: DataFrame, meta: DataFrame, on: Sequence[str]) -> DataFrame:
    """JN-2: a left join; columns of both get the suffix _meta on the right."""
    again = [c for c in meta.columns if c in rows.columns and c not in on]
    return rows.join(meta.withColumnsRenamed({c: f"{c}_meta" for c in again}), list(on), "left")


def crosstab(rows: DataFrame, cluster: str, label: str, values: Sequence) -> DataFrame:
    """AGG-10: counts of each label in each cluster, 0 where there are none, and the row shares."""
    counts = [F.count_if(F.col(label) == v).alias(f"n_{v}") for v in values]
    total = F.count_if(F.col(label).isin(list(values)))
    return rows.groupBy(cluster).agg(*counts, *(F.try_divide(F.count_if(F.col(label) == v), total).alias(f"share_{v}") for v in values))


def purity_nmi(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """AGG-11, 12, T30, A9: one row: the mean over clusters of the largest share, and normalized mutual information.

    All from the joint counts, whose number is clusters times labels.
    """
    joint = rows.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("n"))
    by_c, by_l = Window.partitionBy(cluster), Window.partitionBy(label)
    total = joint.agg(F.sum("n")).first()[0]
    if not total:
        return joint.sparkSession.createDataFrame([], "purity double, nmi double")
    x = joint.withColumns({"nc": F.sum("n").over(by_c), "nl": F.sum("n").over(by_l), "top": F.max("n").over(by_c), "kc": F.count("*").over(by_c), "kl": F.count("*").over(by_l)})
    N = F.lit(float(total))
    out = x.agg(
        F.sum(F.col("n") / N * F.ln(N * F.col("n") / (F.col("nc") * F.col("nl")))).alias("mi"),
        (-F.sum(F.col("nc") / N * F.ln(F.col("nc") / N) / F.col("kc"))).alias("hc"), (-F.sum(F.col("nl") / N * F.ln(F.col("nl") / N) / F.col("kl"))).alias("hl"),
        (F.sum(F.col("top") / F.col("nc") / F.col("kc")) / F.sum(1 / F.col("kc"))).alias("purity"),
    )
    return out.select("purity", F.when((F.col("hc") + F.col("hl")) / 2 > 1e-12, F.col("mi") / ((F.col("hc") + F.col("hl")) / 2)).otherwise(1.0).alias("nmi"))


def wilson_shares(rows: DataFrame, cluster: str, label: str, values: Sequence, z: float = 1.96) -> DataFrame:
    """AGG-13, JN-9, A12: each cluster and value, also those never seen: k, n, share and Wilson bounds."""
    wide = rows.groupBy(cluster).agg(F.count("*").alias("n"), *(F.count_if(F.col(label) == v).alias(f"k{i}") for i, v in enumerate(values)))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("class"), F.col(f"k{i}").alias("k")) for i, v in enumerate(values)))).alias("e")
    long = wide.select(cluster, "n", each).select(cluster, "e.class", "e.k", "n")
    lo, hi = breaks.wilson(F.col("k").cast("double"), F.col("n").cast("double"), z)
    return long.select(F.concat(F.lit("C"), F.col(cluster).cast("string")).alias("cluster"), "class", F.try_divide("k", "n").alias("share"), lo.alias("lo"), hi.alias("hi"), "n", "k")


def group_means(rows: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """AGG-14: size and means of each cluster, in the order of the first mean."""
    return rows.groupBy(cluster).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns)).orderBy(f"mean_{columns[0]}", cluster)


def box_statistics(rows: DataFrame, cluster: str, column: str) -> DataFrame:
    """AGG-15: the 5, 25, 50, 75 and 95 % points of each cluster."""
    q = quantiles(rows, [cluster], [column], [x / 100 for x in (5, 25, 50, 75, 95)])
    return q.select(cluster, *(F.col(column)[i].alias(f"p{x:02d}") for i, x in enumerate((5, 25, 50, 75, 95))))


def histogram2d(rows: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """AGG-17: (bx, by, n) of equal bins over both ranges; empty ones are left out."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = known.agg(*(f(c).cast("double") for c in (x, y) for f in (F.min, F.max))).first()
    if r[0] is None:
        return known.select(F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(0).cast("long").alias("n")).limit(0)

    def at(c: str, lo: float, hi: float) -> Column:
        return F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1)) if hi > lo else F.lit(0)

    return known.groupBy(at(x, r[0], r[1]).alias("bx"), at(y, r[2], r[3]).alias("by")).agg(F.count("*").alias("n"))


def value_shares(rows: DataFrame, label: str) -> DataFrame:
    """AGG-18, PRJ-35: count and percent, rounded to 2 digits, of each value. The window runs over the counts."""
    return rows.groupBy(label).agg(F.count("*").alias("count")).withColumn("pct", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 2))


def per_period(rows: DataFrame, ts: str, period: str = "week") -> DataFrame:
    """AGG-18, PRJ-21, T39: counts by day or by Monday's week."""
    return rows.groupBy(F.date_trunc(period, ts).cast("date").alias("period")).agg(F.count("*").alias("count"))


def dominant_shares(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """PRJ-10, 11: shares of the parts, and which is largest."""
    s = spectral.shares([F.col(c) for c in parts])
    return rows.withColumns({f"share_{c}": x for c, x in zip(parts, s, strict=True)}).withColumn("dominant", spectral.dominant([F.col(f"share_{c}") for c in parts]))

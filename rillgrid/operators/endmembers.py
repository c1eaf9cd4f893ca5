"""Endmember selection (AGG-2, 3; FLT-4…6; PRJ-7…9; SRT-1; JN-3; AGG-19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillgrid.functions import spectral
from rillgrid.operators.quantiles import quantiles


def at_points(points: DataFrame, raster: DataFrame, key: Sequence[str] = ("row", "col")) -> DataFrame:
    """JN-3: raster values at points; points outside get NULLs. The optimizer picks a broadcast from real sizes."""
    return points.join(raster, list(key), "left")


def with_indices(df: DataFrame, green: Column, red: Column, nir: Column) -> DataFrame:
    """PRJ-9: NDVI and NDWI where the columns are missing or NULL."""
    for name, x in (("NDVI", spectral.ndvi(nir, red)), ("NDWI", spectral.ndwi(green, nir))):
        df = df.withColumn(name, F.coalesce(F.col(name), x) if name in df.columns else x)
    return df


def mean_spectra(spectra: DataFrame, bands: Sequence[str], label: str = "label") -> DataFrame:
    """AGG-3: mean of each band in each class; NULL and NaN are skipped."""
    return spectra.groupBy(label).agg(*(F.avg(F.when(~F.isnan(b), F.col(b))).alias(b) for b in bands))


def matrix(means: DataFrame, bands: Sequence[str], labels: Sequence, label: str = "label") -> list[list[float]]:
    """SRC-9: the classes' spectra as rows, in the order of labels; an error if one is missing."""
    found = {r[label]: [r[b] for b in bands] for r in means.where(F.col(label).isin(list(labels))).limit(len(labels) + 1).collect()}
    if set(found) != set(labels) or any(x is None for row in found.values() for x in row):
        raise ValueError(f"endmember classes {sorted(set(labels) - set(found), key=str)} are missing or have empty bands")
    return [found[x] for x in labels]


def oriented(values: Sequence[Sequence[float]], classes: int = 3) -> list[list[float]]:
    """SRC-9: a classes × bands matrix from either orientation."""
    rows, cols = len(values), len(values[0]) if values else 0
    if rows == classes:
        return [list(map(float, r)) for r in values]
    if cols == classes:
        return [list(map(float, c)) for c in zip(*values, strict=True)]
    raise ValueError(f"an endmember matrix of {rows} x {cols} has no side of {classes}")


def class_stats(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """AGG-2, T24: mean and population deviation by class."""
    return df.groupBy(label).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def land_candidate(ndvi: Column, ndwi: Column, veg: float = 0.42279804, water: float = -0.4510991) -> Column:
    """FLT-6, T4: below vegetation, above the (negative) water level."""
    return (ndvi < veg) & (ndwi > water)


def bare_topk(candidates: DataFrame, veg: DataFrame, water: DataFrame, k: int = 3, order: Sequence[str] = ("row", "col")) -> DataFrame:
    """FLT-4, 5, PRJ-7, 8, SRT-1: candidates beyond both classes' gates, or all if none is, by the least distance to the class centres.

    veg and water: points with NDVI and NDWI. Their two rows of statistics are read to the driver.
    candidates without a flag column is_land_candidate are all candidates (T7).
    """
    v, w = (x.agg(*(f(c).alias(f"{c}_{n}") for c in ("NDVI", "NDWI") for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first() for x in (veg, water))
    if v.NDVI_m is None or w.NDWI_m is None:
        raise ValueError("the vegetation and water classes need points")
    flagged = candidates.where("is_land_candidate") if "is_land_candidate" in candidates.columns else candidates
    gate = (F.col("NDVI") < v.NDVI_m - v.NDVI_s) & (F.col("NDWI") > w.NDWI_m + w.NDWI_s)
    gated = flagged.withColumn("passes", F.coalesce(gate, F.lit(False)))
    some = not gated.where("passes").isEmpty()
    scored = (gated.where("passes") if some else gated).drop("passes")
    near = [spectral.distance(F.col("NDVI"), F.col("NDWI"), F.lit(x.NDVI_m), F.lit(x.NDWI_m)) for x in (v, w)]
    return scored.withColumn("dist_score", F.least(*near)).orderBy(F.desc("dist_score"), *order).limit(k)


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """AGG-16: (bin, left, n) of equal bins over the range; empty bins are left out, the top value falls in the last bin."""
    known = df.where(F.col(column).isNotNull() & ~F.isnan(column))
    r = known.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if r.lo is None:
        return known.select(F.lit(0).alias("bin"), F.lit(0.0).alias("left"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (r.hi - r.lo) / bins
    at = F.least(F.floor((F.col(column) - r.lo) / width).cast("int"), F.lit(bins - 1)) if width else F.lit(0)
    return known.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(r.lo) + F.col("bin") * width).alias("left"), "n")


def multi_otsu(df: DataFrame, column: str, bins: int = 256) -> DataFrame:
    """AGG-19, A8: one row (t1, t2): the centres of the bins that part three classes with the largest variance between them.

    The histogram (at most ``bins`` rows) is all that leaves the executors; its pairs of bins, some 32,000, are compared on the driver.
    """
    r = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if r.lo is None or r.hi == r.lo:
        return df.sparkSession.createDataFrame([(r.lo, r.lo)], "t1 double, t2 double")
    width = (r.hi - r.lo) / bins
    counts = {x.bin: x.n for x in histogram(df, column, bins).collect()}
    n = [float(counts.get(i, 0)) for i in range(bins)]
    centre = [r.lo + (i + 0.5) * width for i in range(bins)]
    w, m = [0.0], [0.0]
    for a, c in zip(n, centre, strict=True):
        w.append(w[-1] + a)
        m.append(m[-1] + a * c)
    part = lambda i, j: (m[j] - m[i]) ** 2 / (w[j] - w[i]) if w[j] > w[i] else 0.0
    best = max(((part(0, i + 1) + part(i + 1, j + 1) + part(j + 1, bins), -i, -j) for i in range(bins - 1) for j in range(i + 1, bins - 1)), default=(0.0, 0, 0))
    return df.sparkSession.createDataFrame([(centre[-best[1]], centre[-best[2]])], "t1 double, t2 double")


def stretched(df: DataFrame, columns: Sequence[str], low: float = 0.5, high: float = 99.5, gamma: float = 1 / 1.8) -> DataFrame:
    """PRJ-6: each column stretched between its own percentiles."""
    r = quantiles(df, [], columns, [low / 100, high / 100]).first() or {}
    return df.select("*", *(spectral.stretched(F.col(c), F.lit(r[c][0]), F.lit(r[c][1]), gamma).alias(f"{c}_rgb") for c in columns if r and r[c] is not None))


def rank_in_class(df: DataFrame, score: Column, label: str, order: Sequence[str]) -> DataFrame:
    """SRT-3: df with rank from 1 in each class, best score first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(score.desc(), *order)))


def unmixed(df: DataFrame, bands: Sequence[str], endmembers: Sequence[Sequence[float]], names: Sequence[str] = ("water", "veg", "bare")) -> DataFrame:
    """KRN-1, T8: df with the non-negative least squares fractions of the endmember spectra, rescaled to sum 1.

    The non-empty active sets have closed solutions from the constant Gram matrix; the feasible one of
    least squared error wins, which is that of the largest product of fractions and right-hand side. The
    products with the spectra, the sets' solutions and the choice are projected one after another, so that
    each is computed once and all stays in code generation. Zeros where no set is feasible; NULL if a band is.
    """
    n = len(endmembers)
    h, fractions = [f"_h{k}" for k in range(n)], {}
    sets = spectral.active_sets(endmembers)
    for k, active in enumerate(sets):
        for p, row in active.items():
            fractions[f"_c{k}_{p}"] = sum((F.col(h[q]) * F.lit(float(x)) for q, x in zip(active, row, strict=True)), F.lit(0.0))
    tried = []
    for k, active in enumerate(sets):
        c = {p: F.col(f"_c{k}_{p}") for p in active}
        feasible = F.lit(True)
        for x in c.values():
            feasible = feasible & (x >= 0)
        error = -sum((x * F.col(h[p]) for p, x in c.items()), F.lit(0.0))
        tried.append(F.when(feasible, F.struct(error.alias("error"), F.lit(k).alias("set"), *(c.get(p, F.lit(0.0)).alias(f"c{p}") for p in range(n)))))
    products = {h[k]: sum((F.col(b) * F.lit(float(v)) for b, v in zip(bands, e, strict=True)), F.lit(0.0)) for k, e in enumerate(endmembers)}
    best = F.least(*tried) if len(tried) > 1 else tried[0]
    solved = df.withColumns(products).withColumns(fractions).withColumn("_best", best)
    total = sum((F.col(f"_best.c{p}") for p in range(n)), F.lit(0.0))
    share = lambda p: F.when(F.col(h[0]).isNotNull(), F.coalesce(F.when(total > 0, F.col(f"_best.c{p}") / total), F.lit(0.0)))
    return solved.select(*(F.col(f"`{c}`") for c in df.columns), *(share(p).alias(name) for p, name in enumerate(names)))

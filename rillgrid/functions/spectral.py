"""Spectral columns (PRJ-1…12, KRN-1). Bands are DOUBLE reflectances; NULL marks a missing value."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, functions as F

EPS = 1e-6  # stands in the denominator of indices alone (T34)
MAX_REFLECTANCE = 1.2


def reflectance(dn: Column, scale: float = 10_000.0) -> Column:
    """PRJ-1: digital numbers to reflectance."""
    return dn / scale


def ndvi(nir: Column, red: Column) -> Column:
    """PRJ-2."""
    return F.try_divide(nir - red, nir + red + EPS)


def ndwi(green: Column, nir: Column) -> Column:
    """PRJ-3."""
    return F.try_divide(green - nir, green + nir + EPS)


def masked(valid: Column, bands: Sequence[Column], fill: Column | None = None) -> list[Column]:
    """PRJ-4: bands where the mask is not 0, else fill (NULL if none is given). A NULL mask is invalid."""
    return [F.when(valid != 0, b).otherwise(fill) for b in bands]


def valid_bands(bands: Sequence[Column], top: float = MAX_REFLECTANCE) -> Column:
    """PRJ-5, T9: true if every band is finite, above 0 and at most top."""
    each = [F.coalesce((b > 0) & (b <= top) & ~F.isnan(b), F.lit(False)) for b in bands]
    out = each[0]
    for c in each[1:]:
        out = out & c
    return out


def stretched(x: Column, low: Column, high: Column, gamma: float = 1 / 1.8) -> Column:
    """PRJ-6: percentile stretch with gamma, clipped to [0, 1]."""
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low + EPS))), F.lit(gamma))


def distance(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """PRJ-7: distance to a class centre in index space."""
    return F.sqrt(F.pow(x - cx, 2) + F.pow(y - cy, 2))


def shares(parts: Sequence[Column]) -> list[Column]:
    """PRJ-10: parts over their sum, clipped to [0, 1]; 0 where the sum is missing, infinite or not positive."""
    total = sum(parts[1:], parts[0])
    good = F.coalesce(~F.isnan(total) & (F.abs(total) < float("inf")) & (total > 0), F.lit(False))
    return [F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(p, total)))).otherwise(0.0) for p in parts]


def dominant(parts: Sequence[Column]) -> Column:
    """PRJ-11, T31: index of the largest part, the first on ties."""
    a = F.array(*parts)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def ternary(bare: Column, veg: Column) -> tuple[Column, Column]:
    """PRJ-12: plane coordinates of a three-part mixture."""
    return bare + veg / 2, F.sqrt(F.lit(3.0)) / 2 * veg


def active_sets(endmembers: Sequence[Sequence[float]]) -> list[dict[int, list[float]]]:
    """For each non-empty set of endmembers that is not collinear: the rows of its inverse Gram matrix, which turn products with a spectrum into fractions."""
    g = [[sum(a * b for a, b in zip(p, q, strict=True)) for q in endmembers] for p in endmembers]
    out = []
    for size in range(1, len(g) + 1):
        for active in combinations(range(len(g)), size):
            m = [[g[p][q] for q in active] for p in active]
            det = _det(m)
            if abs(det) >= 1e-15:
                minor = lambda i, k, m=m: [[x for c, x in enumerate(row) if c != k] for r, row in enumerate(m) if r != i]
                out.append({p: [(-1) ** (i + k) * _det(minor(i, k)) / det for i in range(size)] for k, p in enumerate(active)})
    return out


def _det(m: list[list[float]]) -> float:
    if not m:
        return 1.0
    return sum((-1) ** j * m[0][j] * _det([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m)))

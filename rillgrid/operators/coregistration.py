"""Local co-registration by phase correlation (KRN-10): tie points on a grid of windows, and the scene moved by them.

Tie points are found to a twentieth of a pixel, those that contradict their neighbours are rejected, and the
scene is resampled along the field that is interpolated between the rest. Work is one group for each window with a margin
around it, both of fixed size, so a scene of any size is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

STEPS = 20  # of a pixel, that a refined shift is a multiple of
NONE = -9999.0


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, peak) that moves b onto a: whole pixels by the cross-power spectrum's peak, its height in [0, 1]."""
    cross = np.fft.fft2(a - a.mean()) * np.conj(np.fft.fft2(b - b.mean()))
    r = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    y, x = np.unravel_index(int(r.argmax()), r.shape)
    return float(y - r.shape[0] * (y > r.shape[0] // 2)), float(x - r.shape[1] * (x > r.shape[1] // 2)), float(r.max())


def refined_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, peak) that moves b onto a, to 1 / STEPS pixels: the cross-power spectrum's peak is evaluated on a fine grid around the whole-pixel one.

    The windows' edges are tapered, for what enters on one side is not what leaves on the other, and the
    spectrum is weighted by the common power, for the highest frequencies of resampled images tell nothing.
    """
    def spectra(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taper = np.outer(*(np.hanning(n + 2)[1:-1] for n in a.shape))
        fa, fb = (np.fft.fft2((x - x.mean()) * taper) for x in (a, b))
        cross = fa * np.conj(fb)
        size = np.abs(cross)
        return cross / np.maximum(size, 1e-12 * size.max() + 1e-300), cross / np.maximum(np.sqrt(size), 1e-150)

    height, width = a.shape
    flat, soft = spectra(a, b)
    peak = float(np.fft.ifft2(flat).real.max())
    y, x = (int(k) for k in np.unravel_index(int(np.fft.ifft2(soft).real.argmax()), a.shape))
    y, x = y - height * (y > height // 2), x - width * (x > width // 2)
    if max(abs(y), abs(x)) and height - abs(y) >= 8 and width - abs(x) >= 8:  # the tapers are drawn over what both hold, else they pull the peak to zero
        soft = spectra(a[max(0, y) : height + min(0, y), max(0, x) : width + min(0, x)], b[max(0, -y) : height - max(0, y), max(0, -x) : width - max(0, x)])[1]
        from_y = from_x = 0
    else:
        from_y, from_x = y, x
    fine = np.arange(-STEPS, STEPS + 1) / STEPS
    fy, fx = (np.fft.fftfreq(n) for n in soft.shape)
    near = (np.exp(2j * np.pi * np.outer(from_y + fine, fy)) @ soft @ np.exp(2j * np.pi * np.outer(fx, from_x + fine))).real
    i, j = np.unravel_index(int(near.argmax()), near.shape)
    return float(y + fine[i]), float(x + fine[j]), peak


def tie_points(target: DataFrame, reference: DataFrame, window: int = 64, v: str = "v", pixel_m: float = 3.0, refine: bool = False) -> DataFrame:
    """(scene, win_r, win_c, dx, dy, rel): shifts in metres, reliability 0 to 100, of each whole window; -9999 where a window has gaps or no contrast.

    target: (scene, row, col, v); reference: (row, col, v). refine: below a pixel. A group holds one window, whose size is fixed.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        grids = [np.full((window, window), np.nan) for _ in range(2)]
        r, c = frame["row"].to_numpy() % window, frame["col"].to_numpy() % window
        for g, name in zip(grids, ("ref", "v"), strict=True):
            g[r, c] = frame[name].to_numpy(float)
        dx = dy = NONE
        rel = 0.0
        if all(np.isfinite(g).all() and np.ptp(g) > 0 for g in grids):
            sy, sx, peak = (refined_shift if refine else phase_shift)(*grids)
            dx, dy, rel = sx * pixel_m, sy * pixel_m, 100 * min(1.0, max(0.0, peak))
        return pd.DataFrame([{"scene": frame["scene"].iloc[0], "win_r": int(frame["win_r"].iloc[0]), "win_c": int(frame["win_c"].iloc[0]), "dx": dx, "dy": dy, "rel": rel}])

    both = target.select("scene", "row", "col", F.col(v).alias("v")).join(reference.select("row", "col", F.col(v).alias("ref")), ["row", "col"])
    keyed = both.withColumns({"win_r": F.floor(F.col("row") / window).cast("int"), "win_c": F.floor(F.col("col") / window).cast("int")})
    kind = dict(target.dtypes)["scene"]
    return keyed.groupBy("scene", "win_r", "win_c").applyInPandas(solve, f"scene {kind}, win_r int, win_c int, dx double, dy double, rel double")


def _around(windows: DataFrame, reach: int = 1) -> DataFrame:
    """Each row at its own window, and at those around it, as (win_r, win_c); r and c are its own."""
    steps = F.array(*(F.lit(k) for k in range(-reach, reach + 1)))
    spread = windows.withColumnsRenamed({"win_r": "r", "win_c": "c"}).withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return spread.withColumns({"win_r": F.col("r") + F.col("i"), "win_c": F.col("c") + F.col("j")}).drop("i", "j")


def consistent(ties: DataFrame, most_m: float = 15.0, tolerance_m: float = 3.0, least_rel: float = 0.0) -> DataFrame:
    """Tie points without the outliers: those beyond most_m, below least_rel, or further than tolerance_m from the median of at least two good neighbours (of eight)."""
    good = ties.where((F.col("dx") != NONE) & (F.col("dy") != NONE) & (F.col("rel") >= least_rel) & (F.abs("dx") <= most_m) & (F.abs("dy") <= most_m))
    near = _around(good.select("scene", "win_r", "win_c", "dx", "dy")).where("r <> win_r OR c <> win_c")
    middle = near.groupBy("scene", "win_r", "win_c").agg(F.count("*").alias("_n"), F.percentile("dx", 0.5).alias("_dx"), F.percentile("dy", 0.5).alias("_dy"))
    far = F.coalesce((F.col("_n") >= 2) & ((F.abs(F.col("dx") - F.col("_dx")) > tolerance_m) | (F.abs(F.col("dy") - F.col("_dy")) > tolerance_m)), F.lit(False))
    return good.join(middle, ["scene", "win_r", "win_c"], "left").where(~far).select("scene", "win_r", "win_c", "dx", "dy", "rel")


def displacement(rows: np.ndarray, cols: np.ndarray, ties: dict[tuple[int, int], tuple[float, float]], window: int) -> np.ndarray:
    """(dy, dx) at each place: bilinear between the centres of windows, over those that have a tie point; 0 where none of the four has."""
    y, x = (rows + 0.5) / window - 0.5, (cols + 0.5) / window - 0.5
    r, c = np.floor(y).astype(int), np.floor(x).astype(int)
    total, weight = np.zeros((2, *rows.shape)), np.zeros(rows.shape)
    for (wr, wc), shift in ties.items():
        w = np.where((r == wr) | (r == wr - 1), 1 - np.abs(y - wr), 0.0) * np.where((c == wc) | (c == wc - 1), 1 - np.abs(x - wc), 0.0)
        w = np.maximum(w, 0.0)
        total += w * np.array(shift)[:, None, None]
        weight += w
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), 0.0)


def registered(target: DataFrame, ties: DataFrame, window: int = 64, v: str = "v", pixel_m: float = 3.0, most_m: float = 15.0) -> DataFrame:
    """(scene, row, col, v) on the target's grid, each pixel the bilinear value where the field of the tie points says that it lies.

    NULL where one of the four values is missing. Shifts are at most most_m, which is the margin that a window's group has around it.
    """
    kinds = dict(target.dtypes)
    margin = int(np.ceil(most_m / pixel_m)) + 2
    pixels = target.select("scene", "row", "col", F.col(v).cast("double").alias("v"))
    # A pixel goes to its own window and to those whose margin it lies in.
    edges = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + k) / window).cast("int") for k in sorted({*range(-margin, margin + 1, window), margin}))))
    held = pixels.withColumn("win_r", F.explode(edges("row"))).withColumn("win_c", F.explode(edges("col")))
    near = _around(ties.select("scene", "win_r", "win_c", "dx", "dy"))

    def solve(key: tuple, frame: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        _, wr, wc = key
        if not len(frame):
            return pd.DataFrame({"scene": pd.Series([], dtype=object), "row": [], "col": [], "v": []})
        top, left, side = wr * window - margin, wc * window - margin, window + 2 * margin
        grid, there = np.full((side, side), np.nan), np.zeros((side, side), bool)
        i, j = frame["row"].to_numpy() - top, frame["col"].to_numpy() - left
        grid[i, j], there[i, j] = frame["v"].to_numpy(float), True
        rows, cols = np.mgrid[wr * window : (wr + 1) * window, wc * window : (wc + 1) * window]
        dy, dx = displacement(rows, cols, {(int(r), int(c)): (y / pixel_m, x / pixel_m) for r, c, x, y in zip(around["r"], around["c"], around["dx"], around["dy"], strict=True)}, window)
        y, x = rows - dy - top, cols - dx - left
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        fy, fx = y - y0, x - x0
        out = np.zeros(rows.shape)
        for a, b, w in ((0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)):
            out += np.where(w > 0, w * grid[np.clip(y0 + a, 0, side - 1), np.clip(x0 + b, 0, side - 1)], 0.0)
        own = there[margin : margin + window, margin : margin + window]
        return pd.DataFrame({"scene": pd.Series([key[0]] * int(own.sum()), dtype=object), "row": rows[own], "col": cols[own], "v": out[own]})

    out = held.groupBy("scene", "win_r", "win_c").cogroup(near.groupBy("scene", "win_r", "win_c")).applyInPandas(solve, f"scene {kinds['scene']}, row {kinds['row']}, col {kinds['col']}, v double")
    return out.select("scene", "row", "col", F.when(~F.isnan("v"), F.col("v")).alias(v))


def warped(target: DataFrame, ties: DataFrame, window: int = 64, v: str = "v", pixel_m: float = 3.0, least_rel: float = 0.0) -> DataFrame:
    """(scene, row, col, v) on the target's grid: each window takes the values that its tie point moves there, by whole pixels.

    Windows without a tie point of at least least_rel stay where they are; pixels whose source lies outside the scene are NULL.
    """
    good = (F.col("dx") != -9999.0) & (F.col("rel") >= least_rel)
    shift = ties.where(good).select("scene", "win_r", "win_c", *(F.round(F.col(c) / pixel_m).cast("int").alias(f"_{c}") for c in ("dy", "dx")))
    at = target.select("scene", "row", "col", F.floor(F.col("row") / window).cast("int").alias("win_r"), F.floor(F.col("col") / window).cast("int").alias("win_c"))
    moved = at.join(shift, ["scene", "win_r", "win_c"], "left").withColumns({"_r": F.col("row") - F.coalesce("_dy", F.lit(0)), "_c": F.col("col") - F.coalesce("_dx", F.lit(0))})
    source = target.select("scene", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(v))
    return moved.join(source, ["scene", "_r", "_c"], "left").select("scene", "row", "col", v)

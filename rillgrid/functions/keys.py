"""Keys, names, coordinates and bins (PRJ-13, 14, 17, 18, 21, 26, 27, 31; SRC-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def series_key(row: Column, col: Column) -> Column:
    """PRJ-14."""
    return F.format_string("pix_%d_%d", row, col)


def series_row_col(key: Column) -> tuple[Column, Column]:
    """PRJ-13: row and column of a key, NULL for other strings."""
    return tuple(F.nullif(F.regexp_extract(key, r"pix_(\d+)_(\d+)", k), F.lit("")).cast("int") for k in (1, 2))


def name_timestamp(name: Column) -> Column:
    """SRC-13: the time in a file name, YYYYMMDD_HHMMSS or YYYYMMDD_ at midnight, NULL without either."""
    day_time = F.regexp_extract(name, r"(\d{8})_(\d{6})", 0)
    day = F.regexp_extract(name, r"(\d{8})_", 1)
    digits = F.when(day_time != "", F.replace(day_time, F.lit("_"), F.lit(""))).when(day != "", F.concat(day, F.lit("000000")))
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def renamed(name: Column, suffix: str) -> Column:
    """PRJ-31: name.tif to name_suffix.tif."""
    return F.regexp_replace(name, r"\.tif$", f"_{suffix}.tif")


def original(name: Column, suffix: str) -> Column:
    """PRJ-31, inverse."""
    return F.regexp_replace(name, rf"_{suffix}\.tif$", ".tif")


def map_xy(row: Column, col: Column, transform: Sequence[float]) -> tuple[Column, Column]:
    """PRJ-17: map coordinates of a pixel's centre, by the affine (a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f


def area_ha(pixels: Column, pixel_m: float) -> Column:
    """PRJ-18: hectares of square pixels."""
    return pixels * (pixel_m * pixel_m / 1e4)


def grid_cell(row: Column, col: Column, height: int, width: int, ny: int = 3, nx: int = 5) -> Column:
    """PRJ-26: the cell's name, counted from 1; edges are floor(i * size / n), not equal widths."""

    def index(x: Column, size: int, n: int) -> Column:
        at = F.lit(None).cast("int")
        for i in range(n):
            at = F.when((x >= i * size // n) & (x < (i + 1) * size // n), i + 1).otherwise(at)
        return at

    return F.format_string("y%dx%d", index(row, height, ny), index(col, width, nx))


def occurrence_bin(occ: Column, bins: Sequence[tuple[float, float]] = ((0.0, 0.2), (0.2, 0.6), (0.6, 1.0))) -> Column:
    """PRJ-27, T32: (lo, hi] bins on doubles; NULL outside."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(bins):
        out = F.when((occ > lo) & (occ <= hi), F.lit(f"({lo:.1f},{hi:.1f}]")).otherwise(out)
    return out

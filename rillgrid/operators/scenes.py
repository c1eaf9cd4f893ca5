"""Scenes by name, band count and time (FLT-3, 7, 21; JN-4, 8; SET-4; PRJ-33; SRT-2) and tiles of a grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

# The endings of scene and mask file names.
SCENE_END, MASK_END = "_AnalyticMS_SR_8b_clip.tif", "_udm2_clip.tif"


def mask_name(scene: Column, scene_end: str = SCENE_END, mask_end: str = MASK_END) -> Column:
    """JN-4: the name of a scene's mask; other names stay as they are."""
    return F.replace(scene, F.lit(scene_end), F.lit(mask_end))


def with_masks(scenes: DataFrame, masks: DataFrame, scene: str = "scene", mask: str = "mask", scene_end: str = SCENE_END, mask_end: str = MASK_END) -> DataFrame:
    """JN-4, FLT-3: scenes with their mask, by the derived name; scenes without one are left out. NULL names have none."""
    return scenes.withColumn(mask, mask_name(F.col(scene), scene_end, mask_end)).join(masks, mask)


def with_bands(scenes: DataFrame, bands: int, column: str = "bands") -> DataFrame:
    """FLT-7: scenes of exactly so many bands."""
    return scenes.where(F.size(column) == bands)


def named(scenes: DataFrame, name: str, skip_prefix: str | None = None, tokens: Sequence[str] = ()) -> DataFrame:
    """FLT-21: scenes whose name does not begin with skip_prefix and, if tokens are given, holds one of them."""
    out = scenes.where(~F.startswith(F.col(name), F.lit(skip_prefix))) if skip_prefix else scenes
    hit = F.lit(not tokens)
    for token in tokens:
        hit = hit | F.contains(F.col(name), F.lit(token))
    return out.where(hit)


def first_by_token(scenes: DataFrame, name: str, tokens: Sequence[str]) -> DataFrame:
    """FLT-21: for each token the first name, in order, that holds it; tokens without one are left out."""
    token = F.explode(F.filter(F.array(*(F.lit(t) for t in tokens)), lambda t: F.contains(F.col(name), t))).alias("token")
    return scenes.select(name, token).groupBy("token").agg(F.min(name).alias(name))


def common_times(a: DataFrame, b: DataFrame, on: Sequence[str] = ("series", "ts"), v: str = "v") -> DataFrame:
    """JN-8, SET-4: times at which both series have a value, as v and v_ref."""
    return a.where(F.col(v).isNotNull()).join(b.where(F.col(v).isNotNull()).select(*on, F.col(v).alias(f"{v}_ref")), list(on))


def front(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PRJ-33: these columns first, as far as they exist, then the others."""
    first = [c for c in columns if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """SRT-2: a total order over the columns, NULL last. Names such as C10 sort as text, before C2."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in columns))


@udtf(returnType="tile int, row0 int, row1 int, col0 int, col1 int")
class Tiles:
    """tiles(H, W, size): half-open windows in row-major order; those at the end are cut."""

    def eval(self, height: int, width: int, size: int) -> Iterator[tuple]:
        across = -(-width // size)
        for r in range(0, height, size):
            for k, c in enumerate(range(0, width, size)):
                yield r // size * across + k, r, min(height, r + size), c, min(width, c + size)


def tiles(spark: SparkSession, height: int, width: int, size: int) -> DataFrame:
    """The windows of a grid, from the table function tiles(H, W, size), which is registered for SQL too."""
    if size < 1:
        raise ValueError("tiles need a size of at least 1")
    spark.udtf.register("tiles", Tiles)
    return spark.sql(f"SELECT * FROM tiles({int(height)}, {int(width)}, {int(size)})")

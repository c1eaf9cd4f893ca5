"""CSV, text, Parquet and JSON edges (SRC-5…12, 14…16; SNK-1…9)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from rillgrid.functions import keys


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """SRC-6: with an explicit schema, so that no pass over the file infers one."""
    return spark.read.csv(path, header=True, schema=schema, nanValue="NaN", nullValue="")


def read_wide(spark: SparkSession, path: str, series_prefix: str = "pix_") -> DataFrame:
    """SRC-7, 8: a wide CSV as long rows (series, ts, v). The first column whose name mentions time, else the first, is the time;
    times that don't parse become NULL (T15 drops them downstream), columns without the prefix are left out, empty and NaN values are NULL."""
    text = spark.read.csv(path, header=True)
    time = next((c for c in text.columns if "time" in c.lower() or "date" in c.lower()), text.columns[0] if text.columns else None)
    wide = [c for c in text.columns if c.startswith(series_prefix) and c != time]
    if time is None or not wide:
        raise ValueError(f"no column named {series_prefix}…")
    stamped = text.select(F.try_to_timestamp(F.col(f"`{time}`")).cast("timestamp_ntz").alias("ts"), *(F.col(f"`{c}`") for c in wide))
    long = stamped.unpivot("ts", [F.col(f"`{c}`") for c in wide], "series", "v")
    number = F.expr("try_cast(v AS DOUBLE)")
    return long.select("series", "ts", F.when(~F.isnan(number), number).alias("v"))


def to_wide(long: DataFrame, names: Sequence[str], series: str = "series", ts: str = "ts", v: str = "v") -> DataFrame:
    """SNK-4: long rows as one column for each named series, in time order. For exports of a bounded sample."""
    return long.groupBy(ts).pivot(series, list(names)).agg(F.first(v, ignorenulls=True)).orderBy(ts)


def write_csv(df: DataFrame, path: str, date_format: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """SNK-4, SNK-8: a header, empty cells for NULL; an older folder of that name is replaced."""
    df.write.mode("overwrite").option("timestampNTZFormat", date_format).csv(path, header=True, nullValue="", emptyValue="", timestampFormat=date_format)


def write_json(df: DataFrame, path: str) -> None:
    """SNK-6: run information, a line of JSON for each row."""
    df.write.mode("overwrite").json(path)


def write_raster(df: DataFrame, path: str, values: Sequence[str], nodata: float = -9999.0, tile: int = 512) -> None:
    """SNK-1, 2: values with nodata for NULL and NaN, as Parquet partitioned by tile, so that readers prune by place."""
    filled = df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(nodata)).otherwise(F.col(c)) for c in values})
    tiled = filled.withColumns({"tile_r": F.floor(F.col("row") / tile).cast("int"), "tile_c": F.floor(F.col("col") / tile).cast("int")})
    tiled.repartition("tile_r", "tile_c").write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def read_raster(spark: SparkSession, path: str, values: Sequence[str], nodata: float | str | None = -9999.0) -> DataFrame:
    """SRC-1…5, T2, T3: a raster table; nodata and NaN become NULL, or stay with nodata="literal"."""
    df = spark.read.parquet(path)
    missing = [c for c in ("row", "col", *values) if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    if nodata == "literal":
        return df
    return df.withColumns({c: F.when((F.col(c) != (nodata if nodata is not None else float("nan"))) & ~F.isnan(c), F.col(c)) for c in values})


def read_band(spark: SparkSession, path: str, band: int, nodata: float = -9999.0) -> DataFrame:
    """SRC-2, 4: one band (from 1) of a table of row, col and bands; nodata, NaN and absent bands are NULL."""
    v = F.try_element_at("bands", F.lit(band)).cast("double")
    return spark.read.parquet(path).select("row", "col", F.when((v != nodata) & ~F.isnan(v), v).alias("v"))


def write_matrix(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """SNK-5: a matrix as rows (row, values), in the order of the given columns. For small results such as endmembers."""
    rows = df.select(*order, F.array(*(F.col(c).cast("double") for c in columns)).alias("values")).orderBy(*order).collect()
    df.sparkSession.createDataFrame([(i, r["values"]) for i, r in enumerate(rows)], "row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> list[list[float]]:
    """SNK-5, SRC-9: the matrix of write_matrix."""
    return [r["values"] for r in spark.read.parquet(path).orderBy("row").collect()]


def wide_blocks(long: DataFrame, width: int = 500, series: str = "series", ts: str = "ts", v: str = "v") -> DataFrame:
    """SNK-4 for any number of series, numbered from 0: a row for each time and block of ``width`` series, its values by place in the block."""
    place = F.col(series) - F.col("block") * width
    held = long.withColumn("block", F.floor(F.col(series) / width)).groupBy("block", ts).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int"), F.col(v)))).alias("held"))
    return held.select("block", ts, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.try_element_at("held", k)).alias("values"))


def from_blocks(blocks: DataFrame, width: int = 500, series: str = "series", ts: str = "ts", v: str = "v") -> DataFrame:
    """SRC-7: wide_blocks as long rows again, without the empty places."""
    long = blocks.select("block", ts, F.posexplode("values").alias("k", v))
    return long.where(F.col(v).isNotNull()).select((F.col("block") * width + F.col("k")).cast("long").alias(series), ts, v)


def pending(spark: SparkSession, work: DataFrame, path: str, key: str) -> DataFrame:
    """CTL-5: the work whose key the table at path lacks: an interrupted run goes on from its last written part."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return work
    return work.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")


def write_part(df: DataFrame, path: str, key: str) -> dict:
    """CTL-5, 6: df appended by key; how many rows, seconds and rows a second that took."""
    seen, began = Observation(), time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy(key).parquet(path)
    rows, seconds = seen.get.get("rows", 0), time.perf_counter() - began
    return {"rows": rows, "seconds": seconds, "rate": rows / seconds}


def abundance(bands: Column) -> Column:
    """SRC-16: the only band, or the third of several."""
    return F.when(F.size(bands) == 1, bands[0]).otherwise(F.try_element_at(bands, F.lit(3)))


def read_band_times(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: lines "band N: YYYY-MM-DD HH:MM:SS" as (band, ts); other lines go."""
    parts = [F.regexp_extract("value", r"^\s*band\s+(\d+):\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", k) for k in (1, 2)]
    return spark.read.text(path).where(parts[0] != "").select(parts[0].cast("int").alias("band"), F.to_timestamp(parts[1]).cast("timestamp_ntz").alias("ts"))


def write_band_times(times: DataFrame, path: str) -> None:
    """SNK-3: (band, ts) as those lines."""
    line = F.format_string("band %d: %s", "band", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    times.select(line.alias("value")).write.mode("overwrite").text(path)


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """SRC-11, 13: (path, name, ts, length, modified) of the files, without reading their contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), keys.name_timestamp(name).alias("ts"), "length", F.col("modificationTime").alias("modified"))


def newest(listing: DataFrame) -> str | None:
    """SRC-12: the path that was modified last; ties go to the larger path."""
    return listing.agg(F.max_by("path", F.struct("modified", "path"))).first()[0]


def run_folder(root: str, tag: str, now: datetime | None = None) -> str:
    """SNK-9: a folder name for each run, also for those of one second, so that no run overwrites another."""
    return f"{root.rstrip('/')}/{tag}_{(now or datetime.now()):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def load_or_fit(spark: SparkSession, path: str, fit) -> DataFrame:
    """SRC-15: the table at path, or that of fit(), written there first."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        fit().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

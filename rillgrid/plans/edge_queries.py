"""Queries over edges and smaller operators: what is written is read again and compared, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import SparkSession, Window, functions as F

from rillgrid.functions import breaks, keys, spectral
from rillgrid.operators import clustering, coregistration, endmembers, scenes, segmentation, series, stack
from rillgrid.plans import break_sql, queries, views
from rillgrid.plans.registry import TIE, query, r9
from rillgrid.plans.session import checkpoint, shared_folder
from rillgrid.plans.views import BANDS, table, with_views
from rillgrid.sources import geotiff, tables
from rillgrid.streaming import incremental


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/edges/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------------------------


def _raster(spark, sf):
    """A written raster of the pixels' values on every day, NULL where there is none."""
    path = _place(spark, "raster")
    tables.write_raster(views.obs(spark, sf).select("ts", "row", "col", "v"), path, ["v"], tile=4)
    return path


@query(with_views("daily obs", "SELECT ts, row, col, round(v, 9) AS v FROM obs"))
def raster_roundtrip(spark, sf):
    """SNK-1, 2, SRC-5: nodata in the file, NULL in the table."""
    return r9(tables.read_raster(spark, _raster(spark, sf), ["v"]).select("ts", "row", "col", "v"))


@query(with_views("daily obs", "SELECT ts, row, col, round(coalesce(v, -9999.0), 9) AS v FROM obs"))
def raster_literal(spark, sf):
    """SRC-3: nodata stays a number."""
    return r9(tables.read_raster(spark, _raster(spark, sf), ["v"], nodata="literal").select("ts", "row", "col", "v"))


@query(with_views("daily", "SELECT row, col, count(CASE WHEN v < 0.5 THEN v END) AS n, round(sum(CASE WHEN v < 0.5 THEN v END), 9) AS total FROM daily GROUP BY row, col"))
def band_read(spark, sf):
    """SRC-2, 4: the second of two bands; its nodata is NULL."""
    v = F.when(F.col("v") < 0.5, F.col("v")).otherwise(-9999.0)
    path = _place(spark, "bands")
    views.daily(spark, sf).select("row", "col", F.array(F.lit(1.0), v).alias("bands")).write.parquet(path)
    return r9(tables.read_band(spark, path, 2).groupBy("row", "col").agg(F.count("v").alias("n"), F.sum("v").alias("total")))


@query(with_views("daily", "SELECT series, ts, round(CASE WHEN v < 0.9 THEN v END, 9) AS v FROM daily"))
def csv_roundtrip(spark, sf):
    """SNK-4, 8, SRC-6: a CSV with a header and empty cells that replaces an older one, read with an explicit schema."""
    path = _place(spark, "csv")
    tables.write_csv(views.daily(spark, sf).select("series", "ts", F.lit(-1.0).alias("v")), path)
    tables.write_csv(r9(views.daily(spark, sf).select("series", "ts", F.when(F.col("v") < 0.9, F.col("v")).alias("v"))), path)
    return tables.read_csv(spark, path, "series long, ts date, v double")


@query("SELECT 'pix_0_' || k AS series, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, CAST(count(*) AS DOUBLE) AS v FROM (SELECT ts, CAST(length(event_type) AS BIGINT) AS k FROM events) GROUP BY ALL HAVING count(*) % 7 <> 0")
def wide_csv(spark, sf):
    """SRC-7, 8, SNK-4: series as columns of a CSV; a column that is no series is left out, empty cells are NULL."""
    path = _place(spark, "wide")
    counts = table(spark, sf, "events").groupBy(F.format_string("pix_0_%d", F.length("event_type")).alias("series"), F.to_date("ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").cast("double").alias("v"))
    counts = checkpoint(counts.withColumn("v", F.when(F.col("v") % 7 != 0, F.col("v"))))
    names = sorted(r.series for r in counts.select("series").distinct().collect())  # the columns of the file
    tables.write_csv(tables.to_wide(counts, names).withColumnRenamed("ts", "timestamp").withColumn("note", F.lit("x")), path)
    return tables.read_wide(spark, path).where("v IS NOT NULL")


@query("SELECT CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS band, CAST(d AS TIMESTAMP) AS ts FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)")
def band_times(spark, sf):
    """SNK-3, SRC-10: lines of band times."""
    path = _place(spark, "times")
    days = sorted(r.d for r in table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct().collect())
    tables.write_band_times(spark.createDataFrame([(i, d) for i, d in enumerate(days, 1)], "band int, ts date").unionByName(spark.createDataFrame([(None, None)], "band int, ts date")), path)
    return tables.read_band_times(spark, path)


@query("SELECT strftime(CAST(ts AS DATE), '%Y%m%d_000000_x.parquet') AS name, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) AS newest FROM events GROUP BY ALL")
def file_listing(spark, sf):
    """SRC-11…13: the files of a folder by pattern, the time that each name holds, and the one written last."""
    path = _place(spark, "files")
    days = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").alias("day")).distinct().orderBy("day").collect()
    jvm = spark.sparkContext._jvm
    for k, r in enumerate(days):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{r.day}_000000_x.parquet")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.writeBytes("x")
        out.close()
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setTimes(at, 1_700_000_000_000 + 1000 * k, -1)
    found = tables.files(spark, path, "*_x.parquet")
    return found.select("name", "ts", (F.col("path") == F.lit(tables.newest(found))).alias("newest"))


@query("SELECT 'occurrence' AS run, (SELECT count(*) FROM events) AS rows_read, 0.6::DOUBLE AS threshold")
def run_information(spark, sf):
    """SNK-6, 9: run information as JSON in a folder of its own."""
    path = tables.run_folder(_place(spark, "runs"), "occurrence")
    tables.write_json(table(spark, sf, "events").agg(F.lit("occurrence").alias("run"), F.count("*").alias("rows_read"), F.lit(0.6).alias("threshold")), path)
    return spark.read.schema("run string, rows_read long, threshold double").json(path)


@query(with_views("spectra", "SELECT CAST(label AS INTEGER) AS row, CAST(b - 1 AS INTEGER) AS band, round([" + ", ".join(BANDS) + "][b], 9) AS x FROM (SELECT label, " + ", ".join(f"avg({b}) AS {b}" for b in BANDS) + " FROM (SELECT * REPLACE (label % 3 AS label) FROM spectra) GROUP BY label), range(1, 9) r(b)"))
def matrix_roundtrip(spark, sf):
    """SNK-5, SRC-9: the endmember matrix of three classes, from either orientation."""
    path = _place(spark, "matrix")
    tables.write_matrix(endmembers.mean_spectra(views.spectra(spark, sf).withColumn("label", F.col("label") % 3), BANDS), path, BANDS, ["label"])
    rows = tables.read_matrix(spark, path)
    turned = endmembers.oriented([list(c) for c in zip(*rows, strict=True)])
    assert turned == endmembers.oriented(rows)
    return r9(spark.createDataFrame([(i, k, x) for i, row in enumerate(turned) for k, x in enumerate(row)], "row int, band int, x double"))


@query(with_views("spectra", "SELECT label, count(*) AS n FROM spectra GROUP BY label"))
def load_or_fit(spark, sf):
    """SRC-15: fitted at the first call, loaded at the second."""
    path = _place(spark, "model")
    fit = lambda: views.spectra(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    tables.load_or_fit(spark, path, fit)

    def never():
        raise AssertionError("the table is there")

    return tables.load_or_fit(spark, path, never)


_PLACE = {"transform": (3.0, 0.0, 5e5, 0.0, -3.0, 4e6), "epsg": 32648}


def _daily_scenes(spark, sf):
    """scene, row, col, v, low of every day, and the grid's height."""
    rows = views.daily(spark, sf)
    scene = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_000000_x.tif")).alias("scene")
    return rows.select(scene, "row", "col", "v", (F.col("v") < 0.5).cast("double").alias("low")), 1 + (rows.agg(F.max("row")).first()[0] or 0)


@query(with_views("daily", "SELECT strftime(ts, '%Y%m%d_000000_x.tif') AS scene, row, col, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 9) AS v, v < 0.5 AS low FROM daily"))
def geotiff_roundtrip(spark, sf):
    """SNK-1, 2, SRC-1, 2, 13: a tiled LZW file of two bands for each day, written and read by tasks, without its nodata."""
    pixels, height = _daily_scenes(spark, sf)
    path = _place(spark, "tiff")
    geotiff.write(pixels, path, geotiff.Shape(height, views.WIDTH, 2, **_PLACE), ["v", "low"])
    back = geotiff.read(spark, path).where("bands[0] IS NOT NULL")
    return r9(back.select("scene", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("bands")[0].alias("v"), (F.col("bands")[1] == 1).alias("low")), "v")


@query(with_views("daily", "SELECT row, col, ts, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 9) AS v FROM daily"))
def geotiff_stack(spark, sf):
    """SNK-2, 3, SRC-2, 4, 10: one file with a plane for each date beside the dates' list; both make the stack again."""
    rows, path = views.daily(spark, sf), _place(spark, "stack")
    dates, height = stack.dates(rows), 1 + (rows.agg(F.max("row")).first()[0] or 0)
    wide = rows.groupBy("row", "col").agg(*(F.max(F.when(F.col("ts") == F.lit(t), F.col("v"))).alias(f"b{k}") for k, t in enumerate(dates))).withColumn("scene", F.lit("stack.tif"))
    geotiff.write(wide, path, geotiff.Shape(height, views.WIDTH, len(dates), 16, geotiff.DEFLATE, planar=True, **_PLACE), [f"b{k}" for k in range(len(dates))])
    times = F.element_at(F.array(*(F.lit(t) for t in dates)), F.col("band"))
    back = geotiff.read(spark, path, layout="bands").where("value IS NOT NULL")
    return r9(back.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), times.alias("ts"), F.col("value").alias("v")))


@query(with_views("daily", "SELECT strftime(ts, '%Y%m%d_000000_x.tif') AS scene, CASE WHEN day(ts) % 3 > 0 THEN count(v) ELSE 0 END AS n, CASE WHEN day(ts) % 3 > 0 THEN round(sum(CAST(CAST(v AS FLOAT) AS DOUBLE)), 9) END AS total, CASE WHEN day(ts) % 3 > 0 THEN 'whole' ELSE 'no header' END AS state FROM daily GROUP BY ts"))
def damaged_scenes(spark, sf):
    """CTL-4: of every third day's scene the file is lost to other bytes; the others are read all the same, and each lost one is a row with its error."""
    pixels, height = _daily_scenes(spark, sf)
    path = _place(spark, "damaged")
    geotiff.write(pixels, path, geotiff.Shape(height, views.WIDTH, 1, **_PLACE), ["v"])
    lost = pixels.where("cast(substr(scene, 7, 2) as int) % 3 = 0").select("scene").distinct()
    lost.select("scene", F.lit(0).cast("long").alias("place"), F.lit(b"no raster").alias("raw")).write.format("geotiff").mode("overwrite").save(path)
    rows = geotiff.read(spark, path, errors="rows").groupBy("scene").agg(F.count(F.col("bands")[0]).alias("n"), F.sum(F.col("bands")[0]).alias("total"), F.max("error").alias("error"))
    state = F.when(F.col("error").isNull(), "whole").when(F.col("error").contains("not a TIFF"), "no header").otherwise(F.col("error"))
    return r9(rows.select("scene", "n", "total", state.alias("state")))


@query(with_views("daily", "SELECT count(DISTINCT ts) AS files, true AS same FROM daily"))
def geotiff_profiles(spark, sf):
    """SRC-14: size, reference system and transform agree over all files; their headers alone are read."""
    pixels, height = _daily_scenes(spark, sf)
    path = _place(spark, "profiles")
    geotiff.write(pixels, path, geotiff.Shape(height, views.WIDTH, 1, **_PLACE), ["v"])
    return stack.same_profile(geotiff.read_profiles(spark, path))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_tax WHEN l_linenumber % 3 = 1 THEN l_discount END AS a FROM lineitem")
def abundance_band(spark, sf):
    """SRC-16: the only band, the third of three, NULL of two."""
    one, two = F.array("l_tax"), F.array("l_tax", "l_quantity")
    bands = F.when(F.col("l_linenumber") % 3 == 0, one).when(F.col("l_linenumber") % 3 == 1, F.array("l_tax", "l_quantity", "l_discount")).otherwise(two)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tables.abundance(bands).alias("a"))


@query(with_views("daily", "SELECT series, ts, round(v, 9) AS v FROM daily WHERE (row + col) % 3 = 0"))
def optional_mask(spark, sf):
    """SRC-14: no mask leaves the stack as it is; one of the same profile is applied, another is refused."""
    rows, path = views.daily(spark, sf), _place(spark, "mask")
    like = {"height": 10, "width": views.WIDTH, "crs": "EPSG:32648", "transform": [3.0, 0.0, 5e5, 0.0, -3.0, 4e6]}
    assert stack.mask_if_exists(spark, path, like) is None
    rows.select("row", "col", ((F.col("row") + F.col("col")) % 3 == 0).alias("m")).distinct().write.parquet(path)
    spark.createDataFrame([(10, views.WIDTH, "EPSG:32648", like["transform"])], "height int, width int, crs string, transform array<double>").write.parquet(f"{path}.meta")
    return r9(stack.within(rows, stack.mask_if_exists(spark, path, like)).select("series", "ts", "v"))


@query(with_views("daily", "SELECT row, count(*) AS n, round(sum(v), 9) AS total FROM daily GROUP BY row"))
def resumed_parts(spark, sf):
    """CTL-5, 6: a run that was interrupted goes on with the rows of the grid that are not written yet."""
    path, rows = _place(spark, "parts"), views.daily(spark, sf).select("row", "col", "v")
    tables.write_part(tables.pending(spark, rows, path, "row").where("row % 2 = 0"), path, "row")
    told = tables.write_part(tables.pending(spark, rows, path, "row"), path, "row")
    assert told["seconds"] > 0
    return r9(spark.read.parquet(path).groupBy(F.col("row").cast("long").alias("row")).agg(F.count("*").alias("n"), F.sum("v").alias("total")))


@query(with_views("daily", "SELECT row, count(*) AS n, round(sum(v), 9) AS total FROM daily GROUP BY row"))
def followed_parts(spark, sf):
    """CTL-5, 6: files that arrive in two goes, taken up in batches by runs that go on from each other; the last run has nothing to do."""
    folder, path, state = (_place(spark, x) for x in ("arrivals", "followed", "followed-state"))
    rows = views.daily(spark, sf).select("row", "col", "v")
    runs = []
    for part in ("col % 2 = 0", "col % 2 = 1", None):
        if part:
            rows.where(part).repartition(4, "row", "col").write.mode("append").parquet(folder)
        runs.append(incremental.follow(spark, folder, "row long, col long, v double", path, state, key="row", files=2))
    assert not runs[2] and [b["batch"] for r in runs for b in r] == list(range(len(runs[0]) + len(runs[1])))
    return r9(spark.read.parquet(path).groupBy(F.col("row").cast("long").alias("row")).agg(F.count("*").alias("n"), F.sum("v").alias("total")))


# --- scenes ---------------------------------------------------------------------------------------


def _scenes(spark, sf):
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(scenes.SCENE_END))
    return table(spark, sf, "orders").select("o_orderkey", name.alias("scene"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '_udm2_clip.tif' AS mask FROM orders WHERE o_orderkey % 3 <> 0")
def scene_masks(spark, sf):
    """FLT-3, JN-4."""
    x = _scenes(spark, sf)
    masks = x.where("o_orderkey % 3 != 0").select(scenes.mask_name(F.col("scene")).alias("mask"))
    return scenes.with_masks(x, masks).select("o_orderkey", "mask")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 4")
def band_counts(spark, sf):
    """FLT-7."""
    x = table(spark, sf, "lineitem").withColumn("bands", F.array_repeat("l_tax", F.col("l_linenumber")))
    return scenes.with_bands(x, 4).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE NOT starts_with(strftime(o_orderdate, '%Y%m%d'), '199601') AND (contains(strftime(o_orderdate, '%Y%m%d_') || o_orderkey || '_AnalyticMS_SR_8b_clip.tif', '199602') OR contains(strftime(o_orderdate, '%Y%m%d_') || o_orderkey || '_AnalyticMS_SR_8b_clip.tif', '77_'))")
def name_filters(spark, sf):
    """FLT-21."""
    return scenes.named(_scenes(spark, sf), "scene", "199601", ["199602", "77_"]).select("o_orderkey")


@query("SELECT t AS token, min(scene) AS scene FROM (SELECT strftime(o_orderdate, '%Y%m%d_') || o_orderkey || '_AnalyticMS_SR_8b_clip.tif' AS scene FROM orders), (VALUES ('1995'), ('199602'), ('_99')) v(t) WHERE contains(scene, t) GROUP BY t")
def first_by_token(spark, sf):
    """FLT-21: the first scene of each date token."""
    return scenes.first_by_token(_scenes(spark, sf), "scene", ["1995", "199602", "_99", "nothing"])


@query(with_views("daily obs", ", med AS (SELECT series, ts, v, median(v) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM obs) SELECT series, ts, round(m, 9) AS v, round(v, 9) AS v_ref FROM med WHERE m IS NOT NULL AND v IS NOT NULL").replace("\n, med AS", ", med AS"))
def common_times(spark, sf):
    """JN-8, SET-4: smoothed and raw values at their common times."""
    raw = views.obs(spark, sf).select("series", "ts", "v")
    return r9(scenes.common_times(raw.withColumn("v", series.rolling_median3()), raw))


@query(with_views("daily", """, hw AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM daily)
SELECT CAST((row // 4) * ((w + 3) // 4) + col // 4 AS INTEGER) AS tile, CAST(row // 4 * 4 AS INTEGER) AS row0, CAST(least(any_value(h), row // 4 * 4 + 4) AS INTEGER) AS row1, CAST(col // 4 * 4 AS INTEGER) AS col0, CAST(least(any_value(w), col // 4 * 4 + 4) AS INTEGER) AS col1, count(*) AS n, round(sum(v), 9) AS total
FROM daily, hw GROUP BY row // 4, col // 4, w""").replace("\n, hw AS", ", hw AS"))
def grid_tiles(spark, sf):
    """The table function tiles(H, W, size) over the pixels' grid, and what lies in each window."""
    d = views.daily(spark, sf)
    h, w = d.agg(F.max("row") + 1, F.max("col") + 1).first()
    sums = d.groupBy(F.expr("cast(row div 4 * 4 as int)").alias("row0"), F.expr("cast(col div 4 * 4 as int)").alias("col0")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return r9(scenes.tiles(spark, h, w, 4).join(sums, ["row0", "col0"]).select("tile", "row0", "row1", "col0", "col1", "n", "total"))


@query(with_views("daily", ", c AS (SELECT ts, count(*) AS n, avg(v) AS mean FROM daily GROUP BY ts) SELECT row_number() OVER (ORDER BY 'C' || CAST(n % 13 AS VARCHAR), ts) AS place, 'C' || CAST(n % 13 AS VARCHAR) AS name, ts FROM c").replace("\n, c AS", ", c AS"))
def text_order(spark, sf):
    """SRT-2, PRJ-33: C10 sorts before C2; places follow the partitions of the ordered rows, one for each day."""
    c = views.daily(spark, sf).groupBy("ts").agg(F.count("*").alias("n")).select("ts", F.concat(F.lit("C"), (F.col("n") % 13).cast("string")).alias("name"))
    rows = scenes.ordered(scenes.front(c, ["name", "missing"]), "name", "ts").withColumn("k", F.monotonically_increasing_id())
    return rows.select(F.row_number().over(Window.orderBy("k")).cast("long").alias("place"), "name", "ts")


@query(with_views("daily", """, p AS (SELECT ts, row, col, v, (row // 4) * 4 + col // 4 AS w FROM daily),
t AS (SELECT p.*, CASE WHEN w % 3 = 0 THEN 0 ELSE w % 2 END AS sy, CASE WHEN w % 3 = 0 THEN 0 ELSE w % 3 - 2 END AS sx FROM p)
SELECT strftime(t.ts, '%Y%m%d') AS scene, t.row, t.col, round(s.v, 9) AS v FROM t LEFT JOIN daily s ON s.ts = t.ts AND s.row = t.row - t.sy AND s.col = t.col - t.sx""").replace("\n, p AS", ", p AS"))
def warped_scenes(spark, sf):
    """KRN-10: scenes moved by the tie points of their windows; a third of the windows has none."""
    d = checkpoint(views.daily(spark, sf).select(F.date_format("ts", "yyyyMMdd").alias("scene"), "row", "col", "v"))
    w = F.expr("win_r * 4 + win_c")
    ties = d.select("scene", F.floor(F.col("row") / 4).cast("int").alias("win_r"), F.floor(F.col("col") / 4).cast("int").alias("win_c")).distinct()
    ties = ties.withColumns({"dy": F.when(w % 3 == 0, -9999.0).otherwise(3.0 * (w % 2)), "dx": F.when(w % 3 == 0, -9999.0).otherwise(3.0 * (w % 3 - 2)), "rel": F.lit(50.0)})
    return r9(coregistration.warped(d, ties, 4))


@query()
def registered_scenes(spark, sf):
    """KRN-10: every day's scene against the first day's: tie points below a pixel, without outliers, and the scene moved by their field."""
    d = checkpoint(views.obs(spark, sf).select(F.date_format("ts", "yyyyMMdd").alias("scene"), "row", "col", F.coalesce("v", F.lit(0.0)).alias("v")))
    first = d.agg(F.min("scene")).first()[0]
    ties = coregistration.consistent(coregistration.tie_points(d, d.where(F.col("scene") == first), 8, refine=True))
    return r9(coregistration.registered(d, checkpoint(ties), 8))


# --- columns and aggregates -----------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 10000.0::DOUBLE, 9) AS x FROM lineitem")
def reflectances(spark, sf):
    """PRJ-1."""
    return r9(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", spectral.reflectance(F.col("l_extendedprice")).alias("x")))


@query(with_views("spectra indexed", "SELECT pixel, round(CASE WHEN pixel % 2 = 0 THEN ndvi ELSE 0.25 END, 9) AS \"NDVI\", round(ndwi, 9) AS \"NDWI\" FROM indexed"))
def indices_where_missing(spark, sf):
    """PRJ-9: NDVI is computed where it is NULL, NDWI where there is no column."""
    x = views.spectra(spark, sf).withColumn("NDVI", F.when(F.col("pixel") % 2 == 1, 0.25))
    return r9(endmembers.with_indices(x, F.col("b4"), F.col("b6"), F.col("b8")).select("pixel", "NDVI", "NDWI"))


@query("SELECT c_custkey, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def points_on_raster(spark, sf):
    """JN-3: points outside the raster stay, with NULL."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return endmembers.at_points(table(spark, sf, "customer").select("c_custkey"), n, ["c_custkey"])


@query(with_views("spectra", "SELECT pixel, label, row_number() OVER (PARTITION BY label ORDER BY b4 DESC, pixel) AS rank FROM spectra"))
def class_ranks(spark, sf):
    """SRT-3."""
    return endmembers.rank_in_class(views.spectra(spark, sf), F.col("b4"), "label", ["pixel"]).select("pixel", "label", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, 'scene_' || o_orderkey || '.tif' AS name FROM orders")
def original_names(spark, sf):
    """PRJ-31: the derived name turned back."""
    return table(spark, sf, "orders").select("o_orderkey", keys.original(keys.renamed(F.format_string("scene_%d.tif", "o_orderkey"), "water"), "water").alias("name"))


@query(with_views("daily", "SELECT ts, round(median(v), 9) AS median FROM daily WHERE series IN (SELECT series FROM daily GROUP BY series HAVING count(v) >= 0.9 * (SELECT count(DISTINCT ts) FROM daily)) GROUP BY ts"))
def stable_region_median(spark, sf):
    """AGG-5: over the stable pixels alone."""
    rows = views.daily(spark, sf)
    return r9(stack.region_median(stack.within(rows, stack.stable(rows, views.days(spark, sf), 0.9))))


_MONTHS = ", p AS (SELECT series, ts, lag(v) OVER (PARTITION BY series ORDER BY ts) AS u, v FROM monthly), b AS (SELECT series, ts FROM p WHERE abs(v - u) >= 0.35)"


@query(with_views("monthly", _MONTHS + " SELECT s.series, count(b.ts) AS break_count, count(b.ts) > 0 AS has_break, coalesce(string_agg(strftime(b.ts, '%Y-%m-%d'), ';' ORDER BY b.ts), '') AS break_dates FROM (SELECT DISTINCT series FROM monthly) s LEFT JOIN b USING (series) GROUP BY s.series").replace("\n, p AS", ", p AS"))
def break_counts(spark, sf):
    """AGG-30, PRJ-30: series without a break count 0."""
    m = views.monthly(spark, sf)
    b = m.withColumn("u", F.lag("v").over(Window.partitionBy("series").orderBy("ts"))).where("abs(v - u) >= 0.35")
    return segmentation.with_break_counts(m, b)


@query(with_views("daily obs", queries._POINTS + """, a AS (SELECT series, segment, (count(v) - 1) * coalesce(var_samp(v), 0) AS w FROM sg GROUP BY 1, 2), t AS (SELECT series, (count(*) - 1) * var_samp(v) AS t FROM pt GROUP BY 1)
SELECT series, round(1 - sum(w) / any_value(t), 9) AS twsv_improve FROM a JOIN t USING (series) GROUP BY series""").replace("\n, pt AS", ", pt AS"))
def twsv_finite(spark, sf):
    """AGG-23 with segments weighted by the values that are there."""
    p = segmentation.segments(queries._points(spark, sf), [10, 20])
    return r9(segmentation.twsv(segmentation.segment_statistics(p), p, "finite"))


@query(with_views("daily obs", queries._POINTS + """, a AS (SELECT series, segment, avg(v) AS mu, regr_slope(v, pos) AS slope, min(pos) AS start FROM sg GROUP BY 1, 2), n AS (SELECT series, count(*) AS n FROM pt GROUP BY 1),
b AS (SELECT x.series, y.start AS break_index, y.mu - x.mu AS delta, y.slope - x.slope AS turn, n FROM a x JOIN a y ON x.series = y.series AND y.segment = x.segment + 1 JOIN n ON n.series = x.series)
SELECT series, CAST(break_index AS BIGINT) AS break_index, break_index >= 12 AND break_index <= n - 13 AS inside, abs(delta) >= 0.05 AND abs(turn) >= 0.002 AS all_rules, abs(delta) >= 0.05 OR abs(turn) >= 0.002 AS any_rule,
CASE WHEN NOT (abs(delta) >= 0.05 AND abs(turn) >= 0.002) THEN 'weak/unclear' WHEN delta > 0 THEN 'L→W' ELSE 'W→L' END AS label FROM b""").replace("\n, pt AS", ", pt AS"))
def break_rules(spark, sf):
    """FLT-17, 18, PRJ-23: the guard, both rules and the final label."""
    b = segmentation.break_table(segmentation.segment_statistics(segmentation.segments(queries._points(spark, sf), [10, 20])), 0.05)
    n = views.obs(spark, sf).groupBy("series").agg(F.count("*").alias("n"))
    turn = F.col("slope_post") - F.col("slope_pre")
    rule = lambda name: breaks.quality(F.col("delta"), F.lit(1.0), turn, 0.05, 0.1, 0.002, name)
    return b.join(n, "series").select("series", F.col("break_index").cast("long").alias("break_index"), breaks.inside_edges(F.col("break_index"), F.col("n"), 12).alias("inside"), rule("all").alias("all_rules"), rule("twsv_and_any").alias("any_rule"), breaks.final_label(rule("all"), F.col("delta")).alias("label"))


@query("SELECT 'PELT-l2' AS method, 'penalty' AS criterion, penalty_scale AS crit_scale, CAST(NULL AS INTEGER) AS max_breaks, n_with_breaks, rate FROM (" + queries._sql(break_sql.PELT_SWEEP) + ") UNION ALL SELECT 'Binseg-linear', criterion, scale, 3, n_with_breaks, rate FROM (" + queries._sql(break_sql.BINSEG_SWEEP) + ")")
def merged_summaries(spark, sf):
    """CTL-7, SET-1: the summaries of both sweeps under one another; the columns that one lacks are NULL."""
    pelt = queries.QUERIES["pelt_sweep"](spark, sf).select(F.lit("penalty").alias("criterion"), F.col("penalty_scale").alias("crit_scale"), "n_with_breaks", "rate")
    binseg = queries.QUERIES["binseg_ic"](spark, sf).select("criterion", F.col("scale").alias("crit_scale"), F.lit(3).alias("max_breaks"), "n_with_breaks", "rate")
    return segmentation.merged_summaries({"PELT-l2": pelt, "Binseg-linear": binseg}).select("method", "criterion", "crit_scale", "max_breaks", "n_with_breaks", "rate")


@query(queries._sql(break_sql.FIVES + break_sql.PATHS + break_sql._picked("chosen", "(VALUES (1.0::DOUBLE)) p(ps)") + """, e AS (SELECT c.series, f.pos + 1 AS b FROM (SELECT series, unnest(cuts) AS i FROM chosen) c JOIN f ON f.series = c.series AND f.i = c.i - 1),
s AS (SELECT x.series, x.pos, x.raw, (SELECT count(*) FROM e WHERE e.series = x.series AND e.b <= x.pos) AS segment FROM x)
SELECT series, CAST(segment AS INTEGER) AS segment, count(*) AS length, count(raw) AS n, round(avg(raw), 9) AS mu, min(pos) AS start FROM s GROUP BY series, segment"""))
def pelt_segments(spark, sf):
    """WIN-7, AGG-22: statistics of the raw values in the segments that PELT gives each series."""
    smooth, v = queries._prepared_vectors(spark, sf)
    cuts = segmentation.pelt_breaks(segmentation.pelt_models(v), queries._variances(smooth), [1.0])
    stats = segmentation.segment_statistics(segmentation.segments_by(queries._points(spark, sf), cuts))
    return r9(stats.select("series", "segment", "length", "n", "mu", F.col("start").cast("long").alias("start")))


@query(with_views("daily obs", "SELECT series, ts, round(coalesce(v, avg(v) OVER (PARTITION BY series)), 9) AS v FROM obs"))
def mean_filled(spark, sf):
    """WIN-4."""
    return r9(views.obs(spark, sf).select("series", "ts", series.mean_filled().alias("v")))


@query(with_views("spectra", "SELECT CAST(label AS INTEGER) AS cluster, CAST(b - 1 AS INTEGER) AS place, round([" + ", ".join(f"round(avg({b}), 12)" for b in BANDS).replace("round(avg", "round(avg") + "][b] * 3 + 2, 9) AS v FROM spectra, range(1, 9) r(b) GROUP BY label, b"))
def denormalised_centres(spark, sf):
    """PRJ-20, SRC-15: the classes' centres as a table, with mean 2 and deviation 3."""
    means = endmembers.mean_spectra(views.spectra(spark, sf), BANDS)
    rows = [[round(v, 12) for v in row] for row in endmembers.matrix(means, BANDS, sorted(r.label for r in means.select("label").collect()))]
    out = clustering.denormalised(clustering.centroid_table(spark, np.array(rows)), 2.0, 3.0)
    return r9(out.select("cluster", F.posexplode("v").alias("place", "v")))


# The distance table of each series and centre, one diagonal a step; a cell keeps the one above it (up), which is the
# corner of the cell on its right.
_DTW = f""", {queries._MED}, {queries._FILL},
whole AS (SELECT series FROM fill GROUP BY series HAVING count(v) = count(*)), centre AS (SELECT series, row_number() OVER (ORDER BY series) - 1 AS label FROM whole ORDER BY series LIMIT 4),
v AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM fill WHERE series IN (SELECT series FROM whole)),
cells AS (SELECT v.series, label, v.i, c.i AS j, (v.v - c.v) * (v.v - c.v) AS c FROM v, v c JOIN centre ON centre.series = c.series),
walk AS (SELECT series, label, i, j, c AS d, NULL::DOUBLE AS up FROM cells WHERE i = 1 AND j = 1
  UNION ALL SELECT c.series, c.label, c.i, c.j, c.c + least(coalesce(l.d, 'inf'::DOUBLE), coalesce(u.d, 'inf'::DOUBLE), coalesce(l.up, 'inf'::DOUBLE)), u.d
  FROM (SELECT max(i + j) + 1 AS at FROM walk) g JOIN cells c ON c.i + c.j = g.at
  LEFT JOIN walk l ON l.series = c.series AND l.label = c.label AND l.i = c.i AND l.j = c.j - 1
  LEFT JOIN walk u ON u.series = c.series AND u.label = c.label AND u.i = c.i - 1 AND u.j = c.j),
dist AS (SELECT series, label, sqrt(d) AS d, row_number() OVER (PARTITION BY series ORDER BY sqrt(d), label) AS o FROM walk WHERE i = (SELECT max(i) FROM v) AND j = (SELECT max(i) FROM v))
SELECT x.series, CAST(x.label AS INTEGER) AS label, round(x.d, 9) AS distance, round(y.d - x.d, 9) AS margin FROM dist x JOIN dist y ON x.series = y.series AND x.o = 1 AND y.o = 2"""


@query(break_sql.recursive(with_views("daily obs", _DTW).replace("\n, med AS", ", med AS")))
def dtw_nearest(spark, sf):
    """KRN-7, JN-10, WIN-9, 10: DTW to the first four series, as fixed centres."""
    v = checkpoint(series.vectors(series.prepared(views.obs(spark, sf), scale=False)))
    rows = v.where("NOT exists(v, x -> x IS NULL)").orderBy("series").limit(4).collect()
    return r9(clustering.assign(v, np.array([r.v for r in rows], float)).drop("tables"))


# One round of k-means: every series walks back from the end of the table to its nearest centre's start, by the least of
# the three cells behind (on ties both steps, then the series' own); a centre's place becomes the mean of what meets it there.
_ROUND = _DTW.split("dist AS")[0].replace("SELECT series, v, row_number()", "SELECT series, round(v, 9) AS v, row_number()") + """last AS (SELECT max(i) AS n FROM v),
near AS (SELECT series, label, d FROM walk, last WHERE i = n AND j = n QUALIFY row_number() OVER (PARTITION BY series ORDER BY d, label) = 1),
best AS (SELECT walk.* FROM walk JOIN near USING (series, label)),
path AS (SELECT series, label, n AS i, n AS j FROM near, last
  UNION ALL SELECT series, label, i, j FROM (SELECT p.series, p.label, b.i, b.j, row_number() OVER (PARTITION BY p.series ORDER BY b.d, b.i + b.j, b.j DESC) AS o
  FROM path p JOIN best b ON b.series = p.series AND b.i BETWEEN p.i - 1 AND p.i AND b.j BETWEEN p.j - 1 AND p.j AND b.i + b.j < p.i + p.j) WHERE o = 1),
mean AS (SELECT label, p.j, avg(v.v) AS v FROM path p JOIN v ON v.series = p.series AND v.i = p.i GROUP BY label, p.j),
place AS (SELECT label, row_number() OVER (ORDER BY avg(v), min_by(v, j)) - 1 AS cluster FROM mean GROUP BY label)
SELECT CAST(cluster AS INTEGER) AS cluster, CAST(j - 1 AS INTEGER) AS place, round(v, 9) AS v, (SELECT round(sum(d), 9) FROM near) AS inertia FROM mean JOIN place USING (label)"""


@query(break_sql.recursive(with_views("daily obs", _ROUND).replace("\n, med AS", ", med AS")))
def dtw_round(spark, sf):
    """KRN-8: one round of DTW k-means from the first four series: assignment of all series, then the barycentres, in the order of their means."""
    v = series.vectors(series.prepared(views.obs(spark, sf), scale=False))
    v = checkpoint(v.withColumn("v", F.transform("v", lambda x: F.floor(x * 1e9 + TIE) / 1e9)))
    rows = v.where("NOT exists(v, x -> x IS NULL)").orderBy("series").limit(4).collect()
    centres, inertia = clustering.kmeans(v, 4, iterations=1, start={0: np.array([r.v for r in rows], float)})
    out = clustering.centroid_table(spark, centres).select("cluster", F.posexplode("v").alias("place", "v"))
    return r9(out.withColumn("inertia", F.lit(inertia)))


_BAND = _DTW.replace("AS c FROM v, v c JOIN centre ON centre.series = c.series)", "AS c FROM v, v c JOIN centre ON centre.series = c.series WHERE abs(v.i - c.i) <= 3)").replace("NULL::DOUBLE AS up FROM", "NULL::DOUBLE AS up, NULL::DOUBLE AS lf FROM").replace("coalesce(l.up, 'inf'::DOUBLE)), u.d\n", "coalesce(l.up, u.lf, 'inf'::DOUBLE)), u.d, l.d\n")


@query(break_sql.recursive(with_views("daily obs", _BAND).replace("\n, med AS", ", med AS")))
def dtw_banded(spark, sf):
    """KRN-7, JN-10: DTW within 3 days of the diagonal, by bounds and tables only where these do not decide."""
    v = checkpoint(series.vectors(series.prepared(views.obs(spark, sf), scale=False)))
    rows = v.where("NOT exists(v, x -> x IS NULL)").orderBy("series").limit(4).collect()
    return r9(clustering.assign(v, np.array([r.v for r in rows], float), radius=3).drop("tables"))


_SOFT = _DTW.replace("c.c + least(coalesce(l.d, 'inf'::DOUBLE), coalesce(u.d, 'inf'::DOUBLE), coalesce(l.up, 'inf'::DOUBLE))", "c.c - 1.0 * (-least(coalesce(l.d, 'inf'::DOUBLE), coalesce(u.d, 'inf'::DOUBLE), coalesce(l.up, 'inf'::DOUBLE)) + ln(" + " + ".join(f"coalesce(exp(least(coalesce(l.d, 'inf'::DOUBLE), coalesce(u.d, 'inf'::DOUBLE), coalesce(l.up, 'inf'::DOUBLE)) - {x}), 0)" for x in ("l.d", "u.d", "l.up")) + "))").replace("sqrt(d)", "d")


@query(break_sql.recursive(with_views("daily obs", _SOFT).replace("\n, med AS", ", med AS")))
def softdtw_nearest(spark, sf):
    """KRN-9: soft-DTW (gamma 1) to the first four series, as fixed centres."""
    v = checkpoint(series.vectors(series.prepared(views.obs(spark, sf), scale=False)))
    rows = v.where("NOT exists(v, x -> x IS NULL)").orderBy("series").limit(4).collect()
    return r9(clustering.assign(v, np.array([r.v for r in rows], float), "softdtw").drop("tables"))


@query(break_sql.LONG)
def pelt_long(spark, sf):
    """KRN-2: series of some 2,500 days, by the pruned search."""
    y = r9(table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("ts")).agg(F.avg("l_discount").alias("v")))
    v = checkpoint(y.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "v"))), lambda p: p["v"]).alias("v"), F.var_pop("v").alias("ref_var")))
    found = segmentation.pelt_pruned(v.select("series", "v"), v.select("series", "ref_var", F.col("ref_var").alias("smooth_var")), [0.5, 2.0])
    return r9(found.select("series", "penalty_scale", "m", "rss", F.explode_outer("cuts_full").alias("break_index")), "rss")

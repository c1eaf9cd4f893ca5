"""The registered queries: each operator on whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rillgrid.functions import breaks, keys, spectral
from rillgrid.operators import agreement, clustering, endmembers, sampling, segmentation, series, stack
from rillgrid.plans import break_sql, views
from rillgrid.plans.registry import ORACLE, QUERIES, query, r9
from rillgrid.plans.session import checkpoint
from rillgrid.plans.views import BANDS, table, with_views

__all__ = ["ORACLE", "QUERIES"]
HARD_DROP, BLACKLIST, NOTED = ["20240105", "20240120"], ["2024-01-13"], ["2024-01-08", "2024-01-22"]


# --- stacks -------------------------------------------------------------------------------------


@query(with_views("daily", "SELECT row, col, round(sum(CASE WHEN v > 0.6 THEN 1.0 ELSE 0.0 END) / (SELECT count(DISTINCT ts) FROM daily), 9) AS occ FROM daily GROUP BY row, col"))
def occurrence(spark, sf):
    return r9(stack.occurrence(views.daily(spark, sf), views.days(spark, sf)))


@query(with_views("daily obs", "SELECT row, col, round(avg(CASE WHEN v > 0.6 THEN 1.0 ELSE 0.0 END), 9) AS occ, count(v) AS n, count(*) AS dates FROM obs GROUP BY row, col"))
def occurrence_dense(spark, sf):
    wet = F.avg(F.when(F.col("v") > 0.6, 1.0).otherwise(0.0)).alias("occ")
    return r9(views.obs(spark, sf).groupBy("row", "col").agg(wet, F.count("v").alias("n"), F.count("*").alias("dates")))


@query(with_views("daily", "SELECT row, col, round(count(v) / (SELECT count(DISTINCT ts) FROM daily), 9) AS coverage FROM daily GROUP BY row, col HAVING count(v) >= 0.9 * (SELECT count(DISTINCT ts) FROM daily)"))
def coverage_stable(spark, sf):
    return r9(stack.stable(views.daily(spark, sf), views.days(spark, sf), 0.9))


@query(with_views("daily", "SELECT count(*) AS pixels, round(count(*) * 9.0 / 1e4, 9) AS area_ha FROM (SELECT row, col FROM daily GROUP BY row, col HAVING sum(CASE WHEN v > 0.6 THEN 1 ELSE 0 END) >= 0.6 * (SELECT count(DISTINCT ts) FROM daily))"))
def riverbed_area(spark, sf):
    wet = stack.ever(stack.occurrence(views.daily(spark, sf), views.days(spark, sf)), 0.6)
    return r9(wet.agg(F.count("*").alias("pixels"), keys.area_ha(F.count("*"), 3.0).alias("area_ha")))


@query(with_views("daily", "SELECT row, col, count(*) FILTER (v >= 0.85) AS hits FROM daily GROUP BY row, col HAVING count(*) FILTER (v >= 0.85) >= CAST(floor(0.6 * (SELECT count(DISTINCT ts) FROM daily)) AS BIGINT)"))
def pure_water(spark, sf):
    return stack.pure(views.daily(spark, sf), views.days(spark, sf))


@query(with_views("daily", """, k AS (SELECT count(DISTINCT ts) AS t FROM daily), p AS (
  SELECT row, col, count(v) AS n, sum(CASE WHEN v > 0.6 THEN 1 ELSE 0 END) AS wet FROM daily GROUP BY row, col)
SELECT row, col, round(wet / t, 9) AS occ FROM p, k WHERE n >= 0.9 * t AND wet >= 0.5 * t""".replace(", k AS", ", k AS", 1)).replace("\n, k AS", ", k AS"))
def candidate_domain(spark, sf):
    rows, T = views.daily(spark, sf), views.days(spark, sf)
    return r9(stack.within(stack.ever(stack.occurrence(rows, T), 0.5), stack.stable(rows, T, 0.9)))


@query(with_views("daily", "SELECT ts, round(median(v), 9) AS median FROM daily GROUP BY ts"))
def region_median(spark, sf):
    return r9(stack.region_median(views.daily(spark, sf)))


@query(with_views("daily", "SELECT DISTINCT ts, CASE WHEN strftime(ts, '%Y-%m-%d') IN ('2024-01-08', '2024-01-22') THEN 'note' ELSE '' END AS flag FROM daily WHERE strftime(ts, '%Y%m%d') NOT IN ('20240105', '20240120')"))
def date_flags(spark, sf):
    kept = stack.without_dates(views.daily(spark, sf), HARD_DROP)
    return kept.select("ts", F.when(F.date_format("ts", "yyyy-MM-dd").isin(NOTED), "note").otherwise("").alias("flag")).distinct()


@query(with_views("daily", "SELECT series, count(*) AS n_rows, count(CASE WHEN strftime(ts, '%Y-%m-%d') <> '2024-01-13' THEN v END) AS n FROM daily GROUP BY series"))
def blacklist_dates(spark, sf):
    return stack.blanked_dates(views.daily(spark, sf), BLACKLIST).groupBy("series").agg(F.count("*").alias("n_rows"), F.count("v").alias("n"))


@query(with_views("daily", "SELECT row, count(v) AS n, count(*) FILTER (col < 5) AS inside, round(sum(CASE WHEN col < 5 THEN v END), 9) AS total FROM daily GROUP BY row"))
def mask_to_null(spark, sf):
    rows = views.daily(spark, sf)
    m = stack.masked(rows, rows.where("col < 5")).withColumnRenamed("v", "mv").join(rows.select("row", "col", "ts", "v"), ["row", "col", "ts"])
    return r9(m.groupBy("row").agg(F.count("v").alias("n"), F.count("mv").alias("inside"), F.sum("mv").alias("total")))


@query(with_views("components", "SELECT pixel, round(median(w), 9) AS w, round(median(b), 9) AS b, round(median(v), 9) AS v FROM components GROUP BY pixel"))
def temporal_median(spark, sf):
    return r9(stack.temporal_median(views.components(spark, sf), ["w", "b", "v"], ["pixel"]))


# --- spectra ------------------------------------------------------------------------------------


def _indexed(spark, sf):
    return views.spectra(spark, sf).withColumns({"ndvi": spectral.ndvi(F.col("b8"), F.col("b6")), "ndwi": spectral.ndwi(F.col("b4"), F.col("b8"))})


@query(with_views("spectra indexed", "SELECT pixel, round(ndvi, 9) + 0.0 AS ndvi, round(ndwi, 9) + 0.0 AS ndwi FROM indexed"))
def ndvi_ndwi(spark, sf):
    return r9(_indexed(spark, sf).select("pixel", "ndvi", "ndwi"))


@query(with_views("spectra indexed", "SELECT pixel, ndvi < 0.42279804 AND ndwi > -0.4510991 AS is_land_candidate FROM indexed"))
def land_candidates(spark, sf):
    return _indexed(spark, sf).select("pixel", endmembers.land_candidate(F.col("ndvi"), F.col("ndwi")).alias("is_land_candidate"))


@query(with_views("spectra", "SELECT label, " + ", ".join(f"round(avg({b}), 9) AS {b}" for b in BANDS) + " FROM spectra GROUP BY label"))
def endmember_mean(spark, sf):
    return r9(endmembers.mean_spectra(views.spectra(spark, sf), BANDS))


@query(with_views("spectra indexed", "SELECT label, round(avg(ndvi), 9) AS ndvi_mean, round(stddev_pop(ndvi), 9) AS ndvi_std, round(avg(ndwi), 9) AS ndwi_mean, round(stddev_pop(ndwi), 9) AS ndwi_std FROM indexed GROUP BY label"))
def class_stats(spark, sf):
    return r9(endmembers.class_stats(_indexed(spark, sf), ["ndvi", "ndwi"]))


@query(with_views("spectra indexed", """, v AS (SELECT avg(ndvi) AS m1, stddev_pop(ndvi) AS s1, avg(ndwi) AS m2 FROM indexed WHERE label = 1),
w AS (SELECT avg(ndvi) AS m1, avg(ndwi) AS m2, stddev_pop(ndwi) AS s2 FROM indexed WHERE label = 0),
c AS (SELECT i.*, i.ndvi < v.m1 - v.s1 AND i.ndwi > w.m2 + w.s2 AS passes,
  least(sqrt(pow(i.ndvi - v.m1, 2) + pow(i.ndwi - v.m2, 2)), sqrt(pow(i.ndvi - w.m1, 2) + pow(i.ndwi - w.m2, 2))) AS dist_score
  FROM indexed i, v, w WHERE label > 1)
SELECT pixel, round(dist_score, 9) AS dist_score FROM c WHERE passes OR NOT (SELECT bool_or(passes) FROM c) ORDER BY c.dist_score DESC, pixel LIMIT 3""").replace("\n, v AS", ", v AS"))
def bare_topk(spark, sf):
    x = _indexed(spark, sf).withColumnsRenamed({"ndvi": "NDVI", "ndwi": "NDWI"})
    return r9(endmembers.bare_topk(x.where("label > 1"), x.where("label = 1"), x.where("label = 0"), 3, ["pixel"]).select("pixel", "dist_score"))


@query(with_views("spectra", "SELECT label, count(*) FILTER (" + " AND ".join(f"{b} > 0 AND {b} <= 0.3" for b in BANDS) + ") AS valid, count(*) AS n FROM spectra GROUP BY label"))
def band_validity(spark, sf):
    ok = spectral.valid_bands([F.col(b) for b in BANDS], 0.3)
    return views.spectra(spark, sf).groupBy("label").agg(F.count_if(ok).alias("valid"), F.count("*").alias("n"))


def _nnls(spark, sf):
    x = views.spectra(spark, sf)
    # rounding makes the constants independent of the order of summation
    ends = [[round(v, 12) for v in row] for row in endmembers.matrix(endmembers.mean_spectra(x, BANDS), BANDS, [0, 1, 2])]
    return endmembers.unmixed(x, BANDS, ends).select("pixel", "label", "water", "veg", "bare")


def _nnls_sql(tail: str) -> str:
    e = lambda k, b: f"e{k}.{b}"
    g = ", ".join(f"{' + '.join(f'{e(p, b)} * {e(q, b)}' for b in BANDS)} AS g{p}{q}" for p in range(3) for q in range(p, 3))
    h = ", ".join(f"{' + '.join(f'x.{b} * {e(p, b)}' for b in BANDS)} AS h{p}" for p in range(3))
    G = lambda p, q: f"g{min(p, q)}{max(p, q)}"
    sets = []
    for p in range(3):
        sets.append((p + 1, {p: f"h{p} / {G(p, p)}"}))
    for k, (p, q) in enumerate(((0, 1), (0, 2), (1, 2))):
        det = f"({G(p, p)} * {G(q, q)} - {G(p, q)} * {G(p, q)})"
        sets.append((4 + k, {p: f"(h{p} * {G(q, q)} - h{q} * {G(p, q)}) / {det}", q: f"(h{q} * {G(p, p)} - h{p} * {G(p, q)}) / {det}"}))
    det = "(g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02))"
    sets.append((7, {
        0: f"(h0 * (g11 * g22 - g12 * g12) - g01 * (h1 * g22 - g12 * h2) + g02 * (h1 * g12 - g11 * h2)) / {det}",
        1: f"(g00 * (h1 * g22 - g12 * h2) - h0 * (g01 * g22 - g12 * g02) + g02 * (g01 * h2 - h1 * g02)) / {det}",
        2: f"(g00 * (g11 * h2 - h1 * g12) - g01 * (g01 * h2 - h1 * g02) + h0 * (g01 * g12 - g11 * g02)) / {det}",
    }))
    union = " UNION ALL ".join(f"SELECT pixel, label, g00, g01, g02, g11, g12, g22, h0, h1, h2, {n} AS s, " + ", ".join(f"{c.get(p, '0.0')} AS c{p}" for p in range(3)) + " FROM n" for n, c in sets)
    objective = " + ".join(f"c{p} * c{q} * {G(p, q)}" for p in range(3) for q in range(3)) + " - 2 * (c0 * h0 + c1 * h1 + c2 * h2)"
    return with_views("spectra", f""", m AS (SELECT label, {', '.join(f'round(avg({b}), 12) AS {b}' for b in BANDS)} FROM spectra GROUP BY label),
n AS (SELECT x.pixel, x.label, {g}, {h} FROM spectra x, (SELECT * FROM m WHERE label = 0) e0, (SELECT * FROM m WHERE label = 1) e1, (SELECT * FROM m WHERE label = 2) e2),
u AS ({union}),
best AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY {objective}, s) AS k FROM u WHERE c0 >= 0 AND c1 >= 0 AND c2 >= 0),
f AS (SELECT pixel, label, c0 / (c0 + c1 + c2) AS water, c1 / (c0 + c1 + c2) AS veg, c2 / (c0 + c1 + c2) AS bare FROM best WHERE k = 1)
{tail}""").replace("\n, m AS", ", m AS")  # fmt: skip


@query(_nnls_sql("SELECT pixel, round(water, 9) AS water, round(veg, 9) AS veg, round(bare, 9) AS bare FROM f"))
def nnls_fractions(spark, sf):
    return r9(_nnls(spark, sf).drop("label"))


@query(_nnls_sql("SELECT label, count(*) AS n, round(avg(water), 9) AS water, round(avg(veg), 9) AS veg, round(avg(bare), 9) AS bare FROM f GROUP BY label"))
def fractions_by_label(spark, sf):
    return r9(_nnls(spark, sf).groupBy("label").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("water", "veg", "bare"))))


_SHARE = "s AS (SELECT pixel, median(w) AS w, median(b) AS b, median(v) AS v FROM components GROUP BY pixel), q AS (SELECT pixel, w / (w + b + v) AS w, b / (w + b + v) AS b, v / (w + b + v) AS v FROM s)"


def _shares(spark, sf):
    return agreement.dominant_shares(stack.temporal_median(views.components(spark, sf), ["w", "b", "v"], ["pixel"]), ["w", "b", "v"])


@query(with_views("components", f", {_SHARE} SELECT pixel, round(w, 9) AS share_w, round(b, 9) AS share_b, round(v, 9) AS share_v, CASE WHEN w >= b AND w >= v THEN 0 WHEN b >= v THEN 1 ELSE 2 END AS dominant FROM q").replace("\n, s AS", ", s AS"))
def dominant_class(spark, sf):
    return r9(_shares(spark, sf).drop("w", "b", "v"))


@query(with_views("components", f", {_SHARE} SELECT pixel, round(b + v / 2, 9) AS x, round(sqrt(3.0) / 2 * v, 9) AS y FROM q").replace("\n, s AS", ", s AS"))
def ternary(spark, sf):
    x, y = spectral.ternary(F.col("share_b"), F.col("share_v"))
    return r9(_shares(spark, sf).select("pixel", x.alias("x"), y.alias("y")))


@query(with_views("spectra", ", q AS (SELECT quantile_cont(b6, 0.005) AS l6, quantile_cont(b6, 0.995) AS h6, quantile_cont(b4, 0.005) AS l4, quantile_cont(b4, 0.995) AS h4 FROM spectra) SELECT pixel, round(pow(greatest(0, least(1, (b6 - l6) / (h6 - l6 + 1e-6))), 1 / 1.8), 9) AS b6_rgb, round(pow(greatest(0, least(1, (b4 - l4) / (h4 - l4 + 1e-6))), 1 / 1.8), 9) AS b4_rgb FROM spectra, q").replace("\n, q AS", ", q AS"))
def rgb_stretch(spark, sf):
    return r9(endmembers.stretched(views.spectra(spark, sf), ["b6", "b4"]).select("pixel", "b6_rgb", "b4_rgb"))


@query(with_views("spectra", ", r AS (SELECT min(b4) AS lo, (max(b4) - min(b4)) / 100 AS w FROM spectra) SELECT CAST(least(floor((b4 - lo) / w), 99) AS INTEGER) AS bin, round(any_value(lo) + CAST(least(floor((b4 - lo) / w), 99) AS INTEGER) * any_value(w), 9) AS \"left\", count(*) AS n FROM spectra, r GROUP BY 1").replace("\n, r AS", ", r AS"))
def hist1d(spark, sf):
    return r9(endmembers.histogram(views.spectra(spark, sf), "b4"))


@query(with_views("spectra indexed", """, r AS (SELECT min(ndvi) AS lo, (max(ndvi) - min(ndvi)) / 256 AS w FROM indexed),
h AS (SELECT least(CAST(floor((ndvi - lo) / w) AS INTEGER), 255) AS bin, count(*) AS n FROM indexed, r GROUP BY 1),
a AS (SELECT i.range AS i, coalesce(n, 0) AS n, lo + (i.range + 0.5) * w AS c FROM range(256) i LEFT JOIN h ON h.bin = i.range, r),
s AS (SELECT i, c, sum(n) OVER (ORDER BY i) AS w, sum(n * c) OVER (ORDER BY i) AS m FROM a),
t AS (SELECT max(w) AS w, max_by(m, i) AS m FROM s),
p AS (SELECT x.c AS t1, y.c AS t2, x.i AS i, y.i AS j, (CASE WHEN x.w > 0 THEN x.m * x.m / x.w ELSE 0 END) + (CASE WHEN y.w > x.w THEN (y.m - x.m) * (y.m - x.m) / (y.w - x.w) ELSE 0 END) + (CASE WHEN t.w > y.w THEN (t.m - y.m) * (t.m - y.m) / (t.w - y.w) ELSE 0 END) AS b FROM s x, s y, t WHERE x.i < y.i AND y.i < 255)
SELECT round(t1, 9) AS t1, round(t2, 9) AS t2 FROM p ORDER BY round(b, 9) DESC, i, j LIMIT 1""").replace("\n, r AS", ", r AS"))
def otsu(spark, sf):
    return r9(endmembers.multi_otsu(_indexed(spark, sf), "ndvi"))


# --- series -------------------------------------------------------------------------------------


def _rows3(spark, sf):
    return views.obs(spark, sf).withColumn("v", series.rolling_median3())


_MED = "med AS (SELECT series, ts, median(v) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM obs)"
_FILL = """p AS (SELECT series, ts, v, last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t1, first_value(v IGNORE NULLS) OVER a AS v1
  FROM med WINDOW b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fill AS (SELECT series, ts, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (ts - t0) / (t1 - t0) ELSE coalesce(v0, v1) END AS v FROM p)"""


@query(with_views("daily obs", f", {_MED} SELECT series, ts, round(v, 9) AS v FROM med").replace("\n, med AS", ", med AS"))
def rolling_median(spark, sf):
    return r9(_rows3(spark, sf).select("series", "ts", "v"))


@query(with_views("daily obs", f", {_MED}, {_FILL} SELECT series, ts, round(v, 9) AS v FROM fill").replace("\n, med AS", ", med AS"))
def time_interpolate(spark, sf):
    return r9(series.prepared(views.obs(spark, sf), scale=False).select("series", "ts", "v"))


@query(with_views("daily obs", f", {_MED}, {_FILL} SELECT series, ts, round((v - avg(v) OVER (PARTITION BY series)) / (stddev_pop(v) OVER (PARTITION BY series) + 1e-9), 9) + 0.0 AS v FROM fill").replace("\n, med AS", ", med AS"))
def zscore_series(spark, sf):
    return r9(series.prepared(views.obs(spark, sf)).select("series", "ts", "v"))


@query(with_views("daily obs", "SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, CASE WHEN v IS NOT NULL THEN count(v) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 END AS compressed FROM obs"))
def positions(spark, sf):
    return views.obs(spark, sf).select("series", "ts", series.position().cast("long").alias("pos"), series.compressed_position().alias("compressed"))


@query("SELECT 'pix_' || (user_id // 15) || '_' || (user_id % 15) AS key, user_id // 15 AS row, user_id % 15 AS col, count(*) AS n FROM events GROUP BY user_id")
def series_keys(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    k = u.select(keys.series_key(F.expr("user_id div 15"), F.col("user_id") % 15).alias("key"), "n")
    row, col = keys.series_row_col(F.col("key"))
    return k.select("key", row.cast("long").alias("row"), col.cast("long").alias("col"), "n")


@query(with_views("daily", "SELECT series, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(v), 9) AS total FROM daily GROUP BY series"))
def wide_roundtrip(spark, sf):
    """All series go wide, in blocks, and back."""
    from rillgrid.sources import tables

    back = tables.from_blocks(tables.wide_blocks(views.daily(spark, sf)))
    return r9(back.groupBy("series").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("v").alias("total")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS ts, 'scene_' || o_orderkey || '_water.tif' AS out_name FROM orders")
def name_timestamps(spark, sf):
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("_000000_x.tif"))).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("_x.tif"))).otherwise("plain.tif")
    out = keys.renamed(F.format_string("scene_%d.tif", "o_orderkey"), "water")
    return o.select(F.col("o_orderkey").alias("k"), keys.name_timestamp(name).alias("ts"), out.alias("out_name"))


@query(with_views("daily", "SELECT DISTINCT row, col, round(3.0 * (col + 0.5) + 500000, 9) AS easting, round(-3.0 * (row + 0.5) + 4000000, 9) AS northing FROM daily"))
def map_coordinates(spark, sf):
    x, y = keys.map_xy(F.col("row"), F.col("col"), (3.0, 0.0, 500000.0, 0.0, -3.0, 4000000.0))
    return r9(views.daily(spark, sf).select("row", "col").distinct().select("row", "col", x.alias("easting"), y.alias("northing")))


# --- quality and agreement ----------------------------------------------------------------------


@query(with_views("tiepoints", "SELECT scene, round(avg(dx), 9) + 0.0 AS mean_dx, round(avg(dy), 9) + 0.0 AS mean_dy, round(sqrt(avg(dx * dx + dy * dy)), 9) AS rmse, count(*) AS num_points FROM tiepoints WHERE dx <> -9999 AND dy <> -9999 AND rel >= 10 AND scene <> 1 GROUP BY scene"))
def coreg_stats(spark, sf):
    return r9(agreement.shift_statistics(views.tiepoints(spark, sf), reference=1))


@query(with_views("daily", """, x AS (SELECT series, ts, v AS abun, CASE WHEN series % 7 <> 0 OR ts < DATE '2024-01-10' THEN round(1 - v * v + (series % 3) / 10.0, 9) END AS ndwi FROM daily),
o AS (SELECT series, abun AS a0, ndwi AS n0 FROM x WHERE ts = (SELECT min(ts) FROM x)),
j AS (SELECT x.ts, abun, ndwi, abun - a0 AS da, ndwi - n0 AS dn, abun IS NOT NULL AND ndwi IS NOT NULL AND a0 IS NOT NULL AND n0 IS NOT NULL AS ok FROM x LEFT JOIN o USING (series) WHERE ts <> (SELECT min(ts) FROM x))
SELECT ts, count(*) AS pixels, count(*) FILTER (ok) AS valid,
  round((covar_pop(abun, ndwi) FILTER (ok)) / ((stddev_pop(abun) FILTER (ok)) * (stddev_pop(ndwi) FILTER (ok))), 9) AS corr_abun_ndwi,
  round(avg(CASE WHEN da > 0.2 AND dn > -0.05 THEN 1.0 ELSE 0.0 END) FILTER (ok), 9) AS suspicious_frac,
  round(quantile_cont(da, 0.5) FILTER (ok), 9) + 0.0 AS delta_abun_median, round(quantile_cont(da, 0.95) FILTER (ok), 9) + 0.0 AS delta_abun_p95, round(quantile_cont(dn, 0.5) FILTER (ok), 9) + 0.0 AS delta_ndwi_median
FROM j GROUP BY ts HAVING count(*) FILTER (ok) >= 0.2 * count(*)""").replace("\n, x AS", ", x AS"))
def delta_qa(spark, sf):
    d = views.daily(spark, sf)
    ndwi = F.when((F.col("series") % 7 != 0) | (F.col("ts") < F.lit("2024-01-10").cast("date")), 1 - F.col("v") * F.col("v") + (F.col("series") % 3) / 10.0)
    x = r9(d.select("series", "ts", F.col("v").alias("abun"), ndwi.alias("ndwi")), "ndwi")
    base = agreement.base_scene(x.select("ts").distinct(), "ts", "no such scene")
    return r9(agreement.delta_qa(x, base, "ts", ["series"]))


@query("SELECT c_custkey AS k, substr(c_name, 1, 16) AS p, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE (SELECT min(d.c_name) FROM customer d WHERE contains(d.c_name, substr(c.c_name, 1, 16)) AND d.c_custkey % 2 = 0) END AS image FROM customer c")
def scene_pairing(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    images = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("image"))
    p = agreement.paired_by_prefix(c, images, "c_name", "image", 16)
    return p.select(F.col("c_custkey").alias("k"), F.substring("c_name", 1, 16).alias("p"), "image")


_CLS = "SELECT o_custkey % 12 AS cluster, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3 AS cls, o_totalprice AS x FROM orders"


def _classes(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") % 12).alias("cluster"), (F.substring("o_orderpriority", 1, 1).cast("int") % 3).alias("cls"), F.col("o_totalprice").alias("x"))


@query(f"WITH r AS ({_CLS}) SELECT cluster, " + ", ".join(f"count(*) FILTER (cls = {v}) AS n_{v}" for v in range(4)) + ", " + ", ".join(f"round(count(*) FILTER (cls = {v}) / count(*), 9) AS share_{v}" for v in range(4)) + " FROM r GROUP BY cluster")
def crosstab(spark, sf):
    return r9(agreement.crosstab(_classes(spark, sf), "cluster", "cls", [0, 1, 2, 3]))


@query(f"""WITH r AS ({_CLS}), j AS (SELECT cluster, cls, count(*) AS n FROM r GROUP BY 1, 2),
c AS (SELECT cluster, sum(n) AS n, max(n) AS top FROM j GROUP BY 1), l AS (SELECT cls, sum(n) AS n FROM j GROUP BY 1), t AS (SELECT sum(n) AS n FROM j)
SELECT round((SELECT avg(top / n) FROM c), 9) AS purity, round((SELECT sum(j.n / t.n * ln(t.n * j.n / (c.n * l.n))) FROM j JOIN c USING (cluster) JOIN l USING (cls), t)
  / (((SELECT -sum(c.n / t.n * ln(c.n / t.n)) FROM c, t) + (SELECT -sum(l.n / t.n * ln(l.n / t.n)) FROM l, t)) / 2), 9) AS nmi""")
def purity_nmi(spark, sf):
    return r9(agreement.purity_nmi(_classes(spark, sf), "cluster", "cls"))


@query(f"""WITH r AS ({_CLS}), n AS (SELECT cluster, count(*) AS n FROM r GROUP BY 1), k AS (SELECT n.cluster, v.class, n.n, (SELECT count(*) FROM r WHERE r.cluster = n.cluster AND r.cls = v.class) AS k FROM n, (VALUES (0), (1), (2), (3)) v(class)),
w AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS den FROM k)
SELECT 'C' || cluster AS cluster, class, round(p, 9) AS share, round((p + 3.8416 / (2 * n)) / den - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / den, 9) + 0.0 AS lo, round((p + 3.8416 / (2 * n)) / den + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / den, 9) AS hi, n, k FROM w""")
def wilson(spark, sf):
    return r9(agreement.wilson_shares(_classes(spark, sf), "cluster", "cls", [0, 1, 2, 3]))


@query(f"WITH r AS ({_CLS}) SELECT cluster, count(*) AS n, round(avg(x), 6) AS mean_x FROM r GROUP BY cluster")
def cluster_means(spark, sf):
    means = agreement.group_means(_classes(spark, sf), "cluster", ["x"])
    return means.withColumn("mean_x", F.round("mean_x", 6))


@query(f"WITH r AS ({_CLS}) SELECT cluster, " + ", ".join(f"round(quantile_cont(x, {q / 100}), 9) AS p{q:02d}" for q in (5, 25, 50, 75, 95)) + " FROM r GROUP BY cluster")
def boxstats(spark, sf):
    return r9(agreement.box_statistics(_classes(spark, sf), "cluster", "x"))


@query("WITH r AS (SELECT min(l_quantity) AS lx, max(l_quantity) AS hx, min(l_tax) AS ly, max(l_tax) AS hy FROM lineitem) SELECT least(CAST(floor((l_quantity - lx) / ((hx - lx) / 20)) AS INTEGER), 19) AS bx, least(CAST(floor((l_tax - ly) / ((hy - ly) / 20)) AS INTEGER), 19) AS \"by\", count(*) AS n FROM lineitem, r GROUP BY 1, 2")
def hist2d(spark, sf):
    return agreement.histogram2d(table(spark, sf, "lineitem"), "l_quantity", "l_tax")


@query("SELECT event_type, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM events), 2) AS pct FROM events GROUP BY event_type")
def label_shares(spark, sf):
    return agreement.value_shares(table(spark, sf, "events"), "event_type")


@query("SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS period, count(*) AS count FROM orders GROUP BY 1")
def weekly_counts(spark, sf):
    return agreement.per_period(table(spark, sf, "orders"), "o_orderdate")


@query("SELECT o_orderkey, c_name, c_acctbal, o_custkey, CASE WHEN c_custkey IS NOT NULL THEN c_custkey + 1 END AS v_meta FROM (SELECT *, o_custkey AS k FROM orders) o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o.k = c.c_custkey")
def breaks_with_meta(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("k"), F.lit(1).alias("v"))
    c = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal", (F.col("c_custkey") + 1).alias("v"))
    return agreement.with_meta(o, c, ["k"]).select("o_orderkey", "c_name", "c_acctbal", "o_custkey", "v_meta")


@query("SELECT DISTINCT o_custkey, c.c_nationkey FROM orders JOIN customer c ON o_custkey = c.c_custkey")
def samples_with_labels(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey").dropDuplicates()
    return o.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_quantity / 50 ELSE 0.0 END AS q FROM lineitem")
def mask_apply(spark, sf):
    x = table(spark, sf, "lineitem")
    q = spectral.masked((F.col("l_linestatus") == "O").cast("int"), [F.col("l_quantity") / 50], F.lit(0.0))[0]
    return x.select("l_orderkey", "l_linenumber", q.alias("q"))


# --- sampling -----------------------------------------------------------------------------------


def _strata(spark, sf):
    occ = checkpoint(stack.occurrence(views.daily(spark, sf), views.days(spark, sf)))
    rows = occ.agg(F.max("row")).first()[0]
    return sampling.strata(occ, (-1 if rows is None else rows) + 1, views.WIDTH)


_STRATA = """, o AS (SELECT row, col, sum(CASE WHEN v > 0.6 THEN 1.0 ELSE 0.0 END) / (SELECT count(DISTINCT ts) FROM daily) AS occ FROM daily GROUP BY row, col),
hw AS (SELECT max(row) + 1 AS h FROM daily),
s AS (SELECT row, col, occ, CASE WHEN occ > 0 AND occ <= 0.2 THEN '(0.0,0.2]' WHEN occ > 0.2 AND occ <= 0.6 THEN '(0.2,0.6]' WHEN occ > 0.6 AND occ <= 1 THEN '(0.6,1.0]' END AS occ_bin,
 'y' || CASE WHEN row < h // 3 THEN 1 WHEN row < 2 * h // 3 THEN 2 ELSE 3 END || 'x' || CAST(col // 3 + 1 AS INTEGER) AS cell_id, md5('42|' || row || '|' || col) AS p FROM o, hw),
cand AS (SELECT *, row_number() OVER (PARTITION BY occ_bin, cell_id ORDER BY p, row, col) AS k FROM s WHERE occ_bin IS NOT NULL)"""
# Round robin, a turn of one stratum a step: the first of its candidates that no taken pixel blocks, unless it has its quota.
_SPACED = """, lists AS (SELECT row_number() OVER (ORDER BY occ_bin, cell_id) - 1 AS i, occ_bin, cell_id, list({'row': row, 'col': col, 'occ_bin': occ_bin, 'cell_id': cell_id} ORDER BY k) AS c FROM cand GROUP BY occ_bin, cell_id),
size AS (SELECT count(*) AS n, least($quota, max(len(c))) AS rounds FROM lists),
turn AS (SELECT 0 AS step, [{'row': -99::BIGINT, 'col': -99::BIGINT, 'occ_bin': '', 'cell_id': ''}] AS taken
  UNION ALL SELECT step + 1, CASE WHEN len(list_filter(taken, lambda z: z.occ_bin = lists.occ_bin AND z.cell_id = lists.cell_id)) >= $quota THEN taken
    ELSE taken || list_filter(c, lambda y: len(list_filter(taken, lambda z: (y.row - z.row) * (y.row - z.row) + (y.col - z.col) * (y.col - z.col) <= 9)) = 0)[1:1] END
  FROM turn JOIN size ON step < n * rounds JOIN lists ON i = step % n),
sp AS (SELECT unnest(taken, recursive := true) FROM (SELECT unnest(taken[2:]) AS taken FROM (SELECT taken FROM turn ORDER BY step DESC LIMIT 1)))"""


def _spaced_sql(body: str, quota: int = 120) -> str:
    return with_views("daily", _STRATA + _SPACED.replace("$quota", str(quota)) + body).replace("\n, o AS", ", o AS").replace("WITH ", "WITH RECURSIVE ", 1)


_BINS = ["(0.0,0.2]", "(0.2,0.6]", "(0.6,1.0]"]


@query(_spaced_sql(""", every AS (SELECT b.b AS occ_bin, 'y' || y.range || 'x' || x.range AS cell_id FROM (VALUES ('(0.0,0.2]'), ('(0.2,0.6]'), ('(0.6,1.0]')) b(b), range(1, 4) y, range(1, 6) x)
SELECT occ_bin, cell_id, (SELECT count(*) FROM cand WHERE cand.occ_bin = every.occ_bin AND cand.cell_id = every.cell_id) AS candidates, (SELECT count(*) FROM sp WHERE sp.occ_bin = every.occ_bin AND sp.cell_id = every.cell_id) AS sampled FROM every"""))
def strata_candidates(spark, sf):
    c = checkpoint(_strata(spark, sf))
    return sampling.summary(c, sampling.spaced(c), _BINS)


@query(with_views("daily", _STRATA + " SELECT row, col, occ_bin, cell_id, k FROM cand").replace("\n, o AS", ", o AS"))
def strata_shuffled(spark, sf):
    return sampling.shuffled(_strata(spark, sf)).select("row", "col", "occ_bin", "cell_id", F.col("k").cast("long").alias("k"))


@query(with_views("daily", "SELECT row, col FROM (SELECT DISTINCT row, col FROM daily) ORDER BY md5('42|' || row || '|' || col), row, col LIMIT 200"))
def hash_sample(spark, sf):
    return sampling.uniform(views.daily(spark, sf).select("row", "col").distinct())


@query(_spaced_sql(" SELECT row, col, occ_bin, cell_id FROM sp"))
def spaced_sample(spark, sf):
    return sampling.spaced(checkpoint(_strata(spark, sf)))


@query(_spaced_sql(" SELECT row, col, occ_bin, cell_id FROM sp", 1))
def spaced_quota(spark, sf):
    """SMP-3 with a quota that binds: strata at theirs leave room to the others."""
    return sampling.spaced(checkpoint(_strata(spark, sf)), quota=1)


# --- segmentation -------------------------------------------------------------------------------


def _points(spark, sf):
    return views.obs(spark, sf).select("series", "ts", "v", series.position().alias("pos"))


_POINTS = ", pt AS (SELECT series, v, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos FROM obs), sg AS (SELECT *, (CASE WHEN pos >= 10 THEN 1 ELSE 0 END) + (CASE WHEN pos >= 20 THEN 1 ELSE 0 END) AS segment FROM pt)"


@query(with_views("daily obs", _POINTS + " SELECT series, segment, count(*) AS length, count(v) AS n, round(avg(v), 9) AS mu, round(regr_slope(v, pos), 9) + 0.0 AS slope, round(var_samp(v), 9) AS var, round(count(v) * var_pop(v), 9) AS rss_l2, round(regr_syy(v, pos) - regr_sxy(v, pos) * regr_sxy(v, pos) / regr_sxx(v, pos), 9) + 0.0 AS rss_linear, min(pos) AS start FROM sg GROUP BY series, segment").replace("\n, pt AS", ", pt AS"))
def segment_stats(spark, sf):
    s = segmentation.segment_statistics(segmentation.segments(_points(spark, sf), [10, 20]))
    return r9(s.withColumn("start", F.col("start").cast("long")))


@query(with_views("daily obs", _POINTS + """, a AS (SELECT series, segment, avg(v) AS mu, regr_slope(v, pos) AS slope, min(pos) AS start FROM sg GROUP BY 1, 2)
SELECT x.series, CAST(y.start AS BIGINT) AS break_index, CAST(x.segment + 1 AS INTEGER) AS break_k, round(x.mu, 9) AS mu_pre, round(y.mu, 9) AS mu_post, round(x.slope, 9) + 0.0 AS slope_pre, round(y.slope, 9) + 0.0 AS slope_post, round(y.mu - x.mu, 9) + 0.0 AS delta,
CASE WHEN y.mu - x.mu >= 0.05 THEN 'L→W' WHEN y.mu - x.mu <= -0.05 THEN 'W→L' ELSE 'weak/unclear' END AS label FROM a x JOIN a y ON x.series = y.series AND y.segment = x.segment + 1""").replace("\n, pt AS", ", pt AS"))
def break_summary(spark, sf):
    b = segmentation.break_table(segmentation.segment_statistics(segmentation.segments(_points(spark, sf), [10, 20])), 0.05)
    return r9(b.withColumn("break_index", F.col("break_index").cast("long")))


@query(with_views("daily obs", _POINTS + """, a AS (SELECT series, segment, (count(*) - 1) * coalesce(var_samp(v), 0) AS w FROM sg GROUP BY 1, 2), t AS (SELECT series, (count(*) - 1) * var_samp(v) AS t FROM pt GROUP BY 1)
SELECT series, round(1 - sum(w) / any_value(t), 9) + 0.0 AS twsv_improve FROM a JOIN t USING (series) GROUP BY series""").replace("\n, pt AS", ", pt AS"))
def twsv_gain(spark, sf):
    p = segmentation.segments(_points(spark, sf), [10, 20])
    return r9(segmentation.twsv(segmentation.segment_statistics(p), p))


@query(with_views("daily obs", _POINTS + """, c AS (SELECT a.series, b.pos AS break_index, coalesce((count(a.v) FILTER (a.pos < b.pos)) * (var_pop(a.v) FILTER (a.pos < b.pos)), 0) + coalesce((count(a.v) FILTER (a.pos >= b.pos)) * (var_pop(a.v) FILTER (a.pos >= b.pos)), 0) AS rss, max(a.pos) + 1 AS n FROM pt a JOIN pt b ON a.series = b.series GROUP BY a.series, b.pos)
SELECT series, break_index, round(rss, 9) AS rss FROM c WHERE break_index >= 5 AND break_index <= n - 5""").replace("\n, pt AS", ", pt AS"))
def single_break_rss(spark, sf):
    s = segmentation.single_breaks(_points(spark, sf))
    return r9(s.withColumn("break_index", F.col("break_index").cast("long")))


@query(with_views("daily obs", _POINTS + """, a AS (SELECT series, segment, count(v) * var_pop(v) AS rss, count(v) AS n FROM sg GROUP BY 1, 2), m AS (SELECT series, sum(rss) AS rss, sum(n) AS n FROM a GROUP BY 1)
SELECT series, s.s AS scale, round(n * ln(greatest(rss, 1e-12) / n) + s.s * 0.299 * pow(ln(n), 2.1) * 3, 9) AS lwz, round(n * ln(greatest(rss, 1e-12) / n) + s.s * 3 * ln(n), 9) AS bic FROM m, (VALUES (0.6::DOUBLE), (0.8), (1.0), (1.2)) s(s)""").replace("\n, pt AS", ", pt AS"))
def ic_scores(spark, sf):
    s = segmentation.segment_statistics(segmentation.segments(_points(spark, sf), [10, 20])).groupBy("series").agg(F.sum("rss_l2").alias("rss"), F.sum("n").cast("double").alias("n"))
    g = s.withColumn("scale", F.explode(F.array(*(F.lit(x) for x in segmentation.SCALES))))
    args = F.col("rss"), F.lit(2), F.col("n"), 1, F.col("scale")
    return r9(g.select("series", "scale", breaks.lwz(*args).alias("lwz"), breaks.bic(*args).alias("bic")))


def _prepared_vectors(spark, sf):
    smooth = views.obs(spark, sf).withColumn("raw", F.col("v")).withColumn("v", series.rolling_median3())
    return smooth, checkpoint(series.vectors(smooth))


def _variances(smooth):
    return smooth.groupBy("series").agg(F.var_pop("raw").alias("ref_var"), F.var_pop("v").alias("smooth_var"))


def _sql(body: str) -> str:
    return break_sql.recursive(with_views("daily obs", body).replace("\n, med AS", ", med AS"))


@query(_sql(break_sql.PELT_SWEEP))
def pelt_sweep(spark, sf):
    smooth, v = _prepared_vectors(spark, sf)
    models = checkpoint(segmentation.pelt_models(v))
    return segmentation.penalty_sweep(models, checkpoint(_variances(smooth)), v.count())


@query(_sql(break_sql.PELT_BREAKS))
def pelt_breaks(spark, sf):
    smooth, v = _prepared_vectors(spark, sf)
    chosen = segmentation.pelt_breaks(segmentation.pelt_models(v), _variances(smooth), [2.0])
    return r9(chosen.select("series", "penalty_scale", "m", "rss", F.explode_outer("cuts_full").alias("break_index")), "rss")


@query(_sql(break_sql.PELT_CHOSEN))
def pelt_chosen(spark, sf):
    """The breaks under the penalty of the whole sweep that comes nearest to the target rate."""
    smooth, v = _prepared_vectors(spark, sf)
    models, variances = checkpoint(segmentation.pelt_models(v)), checkpoint(_variances(smooth))
    best = segmentation.closest(segmentation.penalty_sweep(models, variances, v.count()), segmentation.PELT_TARGET, ["penalty_scale"])
    n = models.select("series", "n").distinct()
    chosen = segmentation.of_penalty(segmentation.pelt_breaks(models, variances, [best["penalty_scale"]]), best["penalty_scale"]).join(n, "series")
    return chosen.select("series", "penalty_scale", "m", "n", F.explode("cuts_full").alias("b")).select("series", "penalty_scale", "m", segmentation.clipped(F.col("b"), F.col("n")).alias("break_index"))


@query(_sql(break_sql.BINSEG_SWEEP))
def binseg_ic(spark, sf):
    _, v = _prepared_vectors(spark, sf)
    return segmentation.ic_sweep(checkpoint(segmentation.ic_models(v)), v.count())


@query(_sql(break_sql.BOTTOMUP))
def bottomup_models(spark, sf):
    _, v = _prepared_vectors(spark, sf)
    models = segmentation.ic_models(v, "bottomup", cost="l2")
    return r9(models.select("series", "n", "m", "rss", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts")))


def _bfast(spark, sf):
    _, v = _prepared_vectors(spark, sf)
    return segmentation.accepted_bfast(segmentation.bfast_models(v), v, delta_min=0.10, twsv_min=0.10, slope_min=0.001)


@query(_sql(break_sql.BFAST))
def bfast_breaks(spark, sf):
    return r9(_bfast(spark, sf), "mu_pre", "mu_post", "delta", "slope_pre", "slope_post", "twsv_improve")


@query(_sql(break_sql.LABELS))
def label_summary(spark, sf):
    return agreement.value_shares(_bfast(spark, sf), "label")


# --- clusters -----------------------------------------------------------------------------------


def _vectors(spark, sf):
    return checkpoint(series.vectors(series.prepared(views.obs(spark, sf))))


@query(with_views("spectra", ", m AS (SELECT label AS k, " + ", ".join(f"round(avg({b}), 12) AS m{b}" for b in BANDS) + " FROM spectra GROUP BY label), d AS (SELECT pixel, k, sqrt(" + " + ".join(f"({b} - m{b}) * ({b} - m{b})" for b in BANDS) + ") AS d FROM spectra, m), r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY d, k) AS o FROM d) SELECT a.pixel AS series, a.k AS label, round(a.d, 9) AS distance, round(b.d - a.d, 9) AS margin FROM r a JOIN r b ON a.pixel = b.pixel AND a.o = 1 AND b.o = 2").replace("\n, m AS", ", m AS"))
def euclid_assign(spark, sf):
    x = views.spectra(spark, sf)
    means = endmembers.mean_spectra(x, BANDS)
    centres = [[round(v, 12) for v in row] for row in endmembers.matrix(means, BANDS, sorted(r.label for r in means.select("label").collect()))]
    return r9(clustering.euclid_assign(x.select(F.col("pixel").alias("series"), F.array(*BANDS).alias("v")), centres))


@query()
def dtw_assign(spark, sf):
    v = _vectors(spark, sf)
    centres, _ = clustering.kmeans(v)
    return r9(clustering.assign(v, centres).drop("tables"))


@query()
def dtw_kmeans(spark, sf):
    v = _vectors(spark, sf)
    centres, _ = clustering.kmeans(v)
    stats = v.select(F.explode("v").alias("x")).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    return clustering.denormalised(clustering.centroid_table(spark, centres), stats.m, stats.s)


@query(with_views("monthly", "SELECT count(*) AS n, count(DISTINCT series) AS series, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std FROM monthly"))
def global_stats(spark, sf):
    return r9(views.monthly(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("series").alias("series"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")))


@query(with_views("monthly", ", p AS (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) AS k, lag(v) OVER (PARTITION BY series ORDER BY ts) AS u, v FROM monthly), b AS (SELECT series, ts FROM p WHERE abs(v - u) >= 0.35) SELECT series, count(*) AS break_count, string_agg(strftime(ts, '%Y-%m-%d'), ';' ORDER BY ts) AS break_dates FROM b GROUP BY series").replace("\n, p AS", ", p AS"))
def break_dates(spark, sf):
    w = Window.partitionBy("series").orderBy("ts")
    b = views.monthly(spark, sf).withColumn("u", F.lag("v").over(w)).where("abs(v - u) >= 0.35")
    return b.groupBy("series").agg(F.count("*").alias("break_count"), breaks.joined_dates(F.array_sort(F.collect_list("ts"))).alias("break_dates"))

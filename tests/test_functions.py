"""Column functions and relational operators against plain Python, with the traps of missing and odd values."""

import hashlib
import math
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillgrid.functions import breaks, keys, spectral
from rillgrid.operators import agreement, endmembers, sampling, series, stack
from rillgrid.sources import geotiff, raster, tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def nnls(E, x):
    """Projected gradient, as an independent solver."""
    E, x = np.asarray(E, float).T, np.asarray(x, float)
    c, step = np.zeros(E.shape[1]), 1 / np.linalg.norm(E.T @ E, 2)
    for _ in range(60_000):
        c = np.maximum(0, c - step * (E.T @ (E @ c - x)))
    return c / c.sum() if c.sum() > 0 else c


def test_nnls_matches_an_independent_solver(spark):
    rng = np.random.default_rng(1)
    E = rng.random((3, 8)).round(3)
    X = rng.random((12, 8)).round(3)
    X[0] = E[1]
    X[1] = -X[1]
    rows = [(i, *map(float, x)) for i, x in enumerate(X)] + [(99, *([None] + [0.1] * 7))]
    names = [f"b{i}" for i in range(8)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} double" for n in names))
    solved = endmembers.unmixed(df, names, E.tolist())
    assert solved.columns == [*df.columns, "water", "veg", "bare"] and len(solved._jdf.queryExecution().executedPlan().toString()) < 20_000
    got = {r.i: None if r.water is None else [r.water, r.veg, r.bare] for r in solved.collect()}
    for i, x in enumerate(X):
        assert got[i] == pytest.approx(nnls(E, x).tolist(), abs=1e-4)
        assert min(got[i]) >= 0 and sum(got[i]) == pytest.approx(1 if i != 1 else 0)
    assert got[99] is None


def test_indices_masks_and_shares(spark):
    r = one(spark, a=spectral.ndvi(F.lit(0.5), F.lit(0.3)), z=spectral.ndvi(F.lit(0.0), F.lit(0.0)), v=spectral.valid_bands([F.lit(0.1), F.lit(1.2)]), w=spectral.valid_bands([F.lit(0.1), F.lit(1.21)]), n=spectral.valid_bands([F.lit(float("nan")), F.lit(0.5)]), m=spectral.valid_bands([F.lit(None).cast("double"), F.lit(0.5)]))
    assert r.a == pytest.approx(0.2 / 0.800001) and r.z == 0 and r.v and not (r.w or r.n or r.m)
    s = spectral.shares([F.lit(1.0), F.lit(3.0), F.lit(0.0)])
    bad = spectral.shares([F.lit(-9999.0), F.lit(1.0), F.lit(1.0)])
    r = one(spark, a=s[0], b=s[1], d=spectral.dominant(s), x=bad[1], e=spectral.dominant(bad), t=spectral.dominant([F.lit(0.5), F.lit(0.5), F.lit(0.0)]))
    assert (r.a, r.b, r.d, r.x, r.e, r.t) == (0.25, 0.75, 1, 0.0, 0, 0)  # T3, T31


def test_keys_names_and_bins(spark):
    names = ["20240810_102132_44_x.tif", "20240810_x.tif", "plain.tif", "99999999_000000_x.tif"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(keys.name_timestamp(F.col("n"))).collect()] == [datetime(2024, 8, 10, 10, 21, 32), datetime(2024, 8, 10), None, None]
    k = keys.series_row_col(F.lit("pix_12_7"))
    bad = keys.series_row_col(F.lit("pixel"))
    r = one(spark, a=k[0], b=k[1], c=bad[0], k=keys.series_key(F.lit(12), F.lit(7)), n=keys.renamed(F.lit("a.tif"), "water"), o=keys.original(F.lit("a_water.tif"), "water"))
    assert tuple(r) == (12, 7, None, "pix_12_7", "a_water.tif", "a.tif")
    edges = np.linspace(0, 100, 4, dtype=int), np.linspace(0, 17, 6, dtype=int)
    rows = [(y, x) for y in range(100) for x in range(17)]
    got = spark.createDataFrame(rows, "row int, col int").select("row", "col", keys.grid_cell(F.col("row"), F.col("col"), 100, 17).alias("c")).collect()
    assert all(g.c == f"y{np.searchsorted(edges[0], g.row, 'right')}x{np.searchsorted(edges[1], g.col, 'right')}" for g in got)
    r = one(spark, **{f"o{i}": keys.occurrence_bin(F.lit(x)) for i, x in enumerate((0.0, 0.2, 0.2000001, 0.6, 1.0))})
    assert tuple(r) == (None, "(0.0,0.2]", "(0.2,0.6]", "(0.2,0.6]", "(0.6,1.0]")


def test_break_columns(spark):
    lo, hi = breaks.wilson(F.lit(3.0), F.lit(10.0))
    z = breaks.wilson(F.lit(0.0), F.lit(0.0))
    r = one(spark, lo=lo, hi=hi, z=z[0], f=breaks.final_label(F.lit(True), F.lit(None).cast("double")), g=breaks.raw_label(F.lit(-0.15), 0.15))
    p, n = 0.3, 10
    den, half = 1 + 1.96**2 / n, 1.96 * math.sqrt(p * 0.7 / n + 1.96**2 / (4 * n * n))
    assert r.lo == pytest.approx((p + 1.96**2 / 20 - half) / den) and r.hi == pytest.approx((p + 1.96**2 / 20 + half) / den)
    assert (r.z, r.f, r.g) == (None, "W→L", "W→L")
    args = F.lit(0.2), F.lit(0.3), F.lit(0.0), 0.15, 0.2, 0.01
    r = one(spark, a=breaks.quality(*args), b=breaks.quality(*args, rule="twsv_and_any"), p=breaks.penalty(F.lit(2.0), F.lit(0.0), F.lit(0.5), F.lit(math.e)))
    assert (r.a, r.b) == (False, True) and r.p == pytest.approx(1.0)  # T12, T17
    with pytest.raises(ValueError):
        breaks.quality(*args, rule="?")


SERIES = [[1.0, None, 3.0, None, None, 6.0, 2.0], [None, None, 4.0, 5.0, None, None, None], [None] * 7, [2.0] * 7]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, date(2024, 1, 1 + 2 * t), v) for i, s in enumerate(SERIES) for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "series int, ts date, v double")


def test_series_windows_match_pandas(long):
    def by_series(df, c="v"):
        out = {}
        for r in df.orderBy("series", "ts").collect():
            out.setdefault(r.series, []).append(float("nan") if r[c] is None else r[c])
        return out

    med = by_series(long.withColumn("v", series.rolling_median3()))
    fill = by_series(long.withColumn("v", series.interpolated()))
    ready = by_series(series.prepared(long))
    index = pd.date_range("2024-01-01", periods=7, freq="2D")
    for i, s in enumerate(SERIES):
        p = pd.Series(s, index, dtype=float)
        np.testing.assert_allclose(med[i], p.rolling(3, center=True, min_periods=1).median(), equal_nan=True)
        f = p.interpolate("time", limit_direction="both").ffill().bfill()
        np.testing.assert_allclose(fill[i], f, equal_nan=True)
        m = p.rolling(3, center=True, min_periods=1).median().interpolate("time").ffill().bfill()
        np.testing.assert_allclose(ready[i], (m - m.mean()) / (m.std(ddof=0) + 1e-9), equal_nan=True, atol=1e-12)


def test_stack_masks(spark):
    T = 10
    rows = [(0, 0, date(2024, 1, 1 + t), 0.9 if t < 6 else None) for t in range(T)] + [(0, 1, date(2024, 1, 1 + t), float("nan") if t else 0.7) for t in range(T)] + [(1, 0, date(2024, 1, 1), None)]
    s = spark.createDataFrame(rows, "row int, col int, ts date, v double")
    occ = {(r.row, r.col): r.occ for r in stack.occurrence(s, T).collect()}
    assert occ == {(0, 0): 0.6, (0, 1): 0.1, (1, 0): 0.0}  # T1
    clean = s.withColumn("v", stack.present())
    assert {(r.row, r.col) for r in stack.stable(clean, T).collect()} == {(0, 0)}  # coverage of exactly 0.60
    assert {(r.row, r.col) for r in stack.pure(clean, 11).collect()} == {(0, 0)}  # int(0.6 * 11) = 6
    grid = stack.dense(clean)
    assert grid.count() == 3 * T and grid.where("v IS NOT NULL").count() == 7
    assert stack.dense(clean.limit(0)).count() == 0
    kept = stack.without_dates(clean, ["20240101"])
    assert kept.count() == 18 and stack.blanked_dates(clean, ["2024-01-01"]).where("v IS NOT NULL").count() == 5
    assert stack.masked(clean, clean.where("col = 0")).where("v IS NOT NULL").count() == 6
    meta = spark.createDataFrame([("a", [3.0, 0.0, 0.0, 0.0, -3.0, 0.0], 5, 5), ("a", [3.0, 0.0, 1e-7, 0.0, -3.0, 0.0], 5, 5)], "crs string, transform array<double>, height int, width int")
    assert stack.same_profile(meta).first().same and not stack.same_profile(meta.withColumn("width", F.monotonically_increasing_id())).first().same


def test_bare_selection_falls_back(spark):
    veg = spark.createDataFrame([(0.6, -0.6), (0.7, -0.7)], "NDVI double, NDWI double")
    water = spark.createDataFrame([(-0.2, -0.5), (-0.1, -0.6)], "NDVI double, NDWI double")
    rows = [(0, 0, 0.2, -0.2), (0, 1, 0.1, -0.3), (0, 2, 0.64, -0.9)]
    c = spark.createDataFrame(rows, "row int, col int, NDVI double, NDWI double")
    assert [r.col for r in endmembers.bare_topk(c, veg, water, 3).collect()] == [0, 1]
    assert [r.col for r in endmembers.bare_topk(c.where("col = 2"), veg, water).collect()] == [2]  # T6
    flagged = c.withColumn("is_land_candidate", F.col("col") == 1)
    assert [r.col for r in endmembers.bare_topk(flagged, veg, water).collect()] == [1]
    with pytest.raises(ValueError):
        endmembers.bare_topk(c, veg.limit(0), water)
    assert endmembers.oriented([[1, 2, 3], [4, 5, 6]]) == [[1, 4], [2, 5], [3, 6]]
    with pytest.raises(ValueError):
        endmembers.oriented([[1, 2], [3, 4]])


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert df.agg(agreement.correlation("a", "b")).first()[0] is None  # T33
    assert df.agg(agreement.correlation("b", "b")).first()[0] == pytest.approx(1.0)


def test_agreement_edges(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (10, 1)], "cluster int, label int")
    r = agreement.purity_nmi(rows, "cluster", "label").first()
    assert r.purity == pytest.approx((2 / 3 + 1) / 2)  # T30
    assert agreement.purity_nmi(rows.where("cluster = 10"), "cluster", "label").first().nmi == 1.0
    assert agreement.purity_nmi(rows.limit(0), "cluster", "label").count() == 0
    w = {(r.cluster, r["class"]): (r.k, r.n) for r in agreement.wilson_shares(rows, "cluster", "label", [0, 1, 2]).collect()}
    assert w["C10", 2] == (0, 1) and w["C0", 0] == (2, 3)
    paired = agreement.paired_by_prefix(spark.createDataFrame([("aa1",), ("aa2",), ("bb",)], "n string"), spark.createDataFrame([("aa2",), ("aa0",)], "i string"), "n", "i", 2)
    assert {r.n: r.i for r in paired.collect()} == {"aa1": "aa0", "aa2": "aa2", "bb": None}  # T35
    meta = agreement.with_meta(spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3)], "k int, v int"), ["k"])
    assert meta.columns == ["k", "v", "v_meta"]


def round_robin(rows, distance, quota):
    """One list for each stratum, one pixel a turn, no shortcuts."""
    lists, taken = {}, []
    for r, c, b, cell in sorted(rows, key=lambda x: (hashlib.md5(f"42|{x[0]}|{x[1]}".encode()).hexdigest(), x[0], x[1])):
        lists.setdefault((b, cell), []).append((r, c))
    moved = True
    while moved:
        moved = False
        for s in sorted(lists):
            if sum(t[2:] == s for t in taken) < quota:
                free = [p for p in lists[s] if all((p[0] - t[0]) ** 2 + (p[1] - t[1]) ** 2 > distance * distance for t in taken)]
                if free:
                    taken.append((*free[0], *s))
                    moved = True
    return taken


@pytest.mark.parametrize(("quota", "ahead", "distance"), [(1000, 4, 3), (2, 4, 3), (5, 1, 3), (8, 1, 5), (3, 2, 0)])
def test_spaced_sample_is_the_round_robin(spark, quota, ahead, distance):
    rng = np.random.default_rng(4)
    pixels = sorted({(int(r), int(c)) for r, c in rng.integers(0, 40, (700, 2))})
    rows = [(r, c, "b" if r % 2 else "a", f"y{r // 20}x{c // 30}") for r, c in pixels]
    df = spark.createDataFrame([*rows, rows[0], (None, 3, "a", "y0x0")], "row int, col int, occ_bin string, cell_id string")
    got = [tuple(r) for r in sampling.spaced(df, distance, quota, ahead=ahead).collect()]
    assert sorted(got) == sorted(round_robin(rows, distance, quota))
    near = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= distance * distance
    full = {s for s in {t[2:] for t in got} if sum(t[2:] == s for t in got) >= quota}
    assert all(not near(p, q) for k, p in enumerate(got) for q in got[:k])  # T38
    assert all(any(near(p, q) for q in got) for p in rows if p[2:] not in full) and (quota == 1000 or full)
    assert sampling.spaced(df.limit(0), distance, quota).count() == 0


def test_csv_edge(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Timestamp,pix_0_1,note,pix_2_3\n2024-01-02 00:00:00,1.5,x,\nbad,2,y,NaN\n2024-01-01 00:00:00,3,z,4\n")
    got = {(r.series, r.ts, r.v) for r in tables.read_wide(spark, str(tmp_path / "w.csv")).collect()}
    a, b = datetime(2024, 1, 2), datetime(2024, 1, 1)
    assert got == {("pix_0_1", a, 1.5), ("pix_2_3", a, None), ("pix_0_1", None, 2.0), ("pix_2_3", None, None), ("pix_0_1", b, 3.0), ("pix_2_3", b, 4.0)}
    (tmp_path / "n.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_wide(spark, str(tmp_path / "n.csv"))
    times = spark.createDataFrame([(1, a), (2, b)], "band int, ts timestamp_ntz")
    tables.write_band_times(times, str(tmp_path / "t"))
    assert {(r.band, r.ts) for r in tables.read_band_times(spark, str(tmp_path / "t")).collect()} == {(1, a), (2, b)}


def test_raster_tables_and_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0.5), (0, 600, None), (600, 0, float("nan"))], "row int, col int, v double")
    tables.write_raster(df, str(tmp_path / "r"), ["v"])
    back = tables.read_raster(spark, str(tmp_path / "r"), ["v"])
    assert {(r.row, r.col): r.v for r in back.collect()} == {(0, 0): 0.5, (0, 600): None, (600, 0): None}
    assert {r.v for r in tables.read_raster(spark, str(tmp_path / "r"), ["v"], "literal").collect()} == {0.5, -9999.0}
    assert "tile_r" in back.where("tile_r = 0")._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        tables.read_raster(spark, str(tmp_path / "r"), ["w"])
    x = np.arange(2 * 5 * 3).reshape(2, 5, 3)
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy" / "scene1.npy", x)
    raster.register(spark)
    got = {(r.row, r.col): r.bands for r in spark.read.format("raster").option("path", str(tmp_path / "npy" / "*.npy")).option("tile_rows", 2).load().collect()}
    assert got == {(r, c): [float(x[0, r, c]), float(x[1, r, c])] for r in range(5) for c in range(3)}
    (tmp_path / "other").mkdir()
    np.save(tmp_path / "other" / "turned.npy", np.asfortranarray(x.astype(">f4")))
    np.save(tmp_path / "other" / "flat.npy", x[1].astype("int16"))
    np.save(tmp_path / "other" / "flat_turned.npy", np.asfortranarray(x[1]))
    np.save(tmp_path / "other" / "none.npy", np.empty((0, 3)))
    both = spark.read.format("raster").option("path", f"file://{tmp_path}/other/*.npy").option("tile_rows", 2).load().collect()
    assert {(r.row, r.col): r.bands for r in both if r.scene == "turned"} == got
    for scene in ("flat", "flat_turned"):
        assert {(r.row, r.col): r.bands for r in both if r.scene == scene} == {k: v[1:] for k, v in got.items()}
    assert len(both) == 45
    listing = tables.files(spark, str(tmp_path / "npy"), "*.npy")
    assert tables.newest(listing).endswith("scene1.npy") and tables.newest(listing.limit(0)) is None
    model = tables.load_or_fit(spark, str(tmp_path / "m"), lambda: df)
    assert tables.load_or_fit(spark, str(tmp_path / "m"), lambda: 1 / 0).count() == model.count() == 3
    r = spark.range(1).select(tables.abundance(F.array(F.lit(1.0))).alias("a"), tables.abundance(F.array(*(F.lit(float(i)) for i in range(4)))).alias("b")).first()
    assert (r.a, r.b) == (1.0, 2.0)


def packed_lzw(data):
    """An encoder of its own for the test."""
    codes, width, table, word, out = [(256, 9)], 9, {bytes([i]): i for i in range(256)}, b"", 0
    size = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        codes.append((table[word], width))
        table[word + bytes([b])] = size
        size += 1
        if size == 4094:
            codes.append((256, 12))
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = max(9, size.bit_length())
        word = bytes([b])
    codes += [(table[word], width)] if word else []
    codes.append((257, max(width, size.bit_length() if size + 1 < 4095 and (size + 1).bit_length() > width else width)))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def tiff(values, order="<", big=False, tile=None, packing=1, predictor=1, planar=1):
    """A file in any of the layouts, written plainly."""
    import struct
    import zlib

    height, width, bands = values.shape
    values = values.astype(values.dtype.newbyteorder(order))
    tall, wide = tile or (3, width)
    chunks = []
    for plane in range(bands) if planar == 2 else [slice(None)]:
        for r in range(0, height, tall):
            for c in range(0, width, wide):
                part = values[r : r + tall, c : c + wide, plane].reshape(min(tall, height - r), min(wide, width - c), -1)
                if tile:
                    part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part.astype(values.dtype.newbyteorder("=")), axis=1, prepend=0).astype(values.dtype)
                raw = part.astype(values.dtype).tobytes()
                if predictor == 3:
                    b = np.frombuffer(part.astype(">f4").tobytes(), np.uint8).reshape(part.shape[0], -1, 4).transpose(0, 2, 1).reshape(part.shape[0], -1, part.shape[2])
                    raw = np.diff(b, axis=1, prepend=np.zeros((b.shape[0], 1, b.shape[2]), np.uint8)).astype(np.uint8).tobytes()
                chunks.append({1: bytes, 5: packed_lzw, 8: zlib.compress}[packing](raw))
    head = 16 if big else 8
    at = np.r_[head, head + np.cumsum([len(x) for x in chunks])].tolist()
    word, pointer = ("Q", 16) if big else ("I", 4)
    where = [(322, 3, [wide]), (323, 3, [tall]), (324, pointer, at[:-1]), (325, pointer, [len(x) for x in chunks])] if tile else [(273, pointer, at[:-1]), (278, 3, [tall]), (279, pointer, [len(x) for x in chunks])]
    fields = sorted([(256, 3, [width]), (257, 3, [height]), (258, 3, [values.dtype.itemsize * 8] * bands), (259, 3, [packing]), (277, 3, [bands]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]] * bands), (33550, 12, [3.0, 2.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]), *where])
    begin = at[-1] + (8 if big else 2) + (20 if big else 12) * len(fields) + (8 if big else 4)
    entries, far = b"", b""
    for tag, type_, content in fields:
        raw = struct.pack(f"{order}{len(content)}{geotiff.TYPES[type_]}", *content)
        entries += struct.pack(order + "HH" + word, tag, type_, len(content))
        room = 8 if big else 4
        entries += raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(order + word, begin + len(far))
        far += raw if len(raw) > room else b""
    magic = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at[-1]) if big else struct.pack(order + "HI", 42, at[-1]))
    return magic + b"".join(chunks) + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + bytes(8 if big else 4) + far


def assembled(data):
    """All blocks of a file in place."""
    form, places, sizes = geotiff.layout(*geotiff.tags(data))
    out = np.empty((form.profile.height, form.profile.width, form.profile.bands), np.dtype(form.dtype).newbyteorder("="))
    for k in range(form.planes * form.across * form.down):
        plane, row, col = form.place(k)
        part = geotiff.decoded(data[places[k] : places[k] + sizes[k]], k, form)
        out[row : row + part.shape[0], col : col + part.shape[1], slice(plane, plane + 1) if form.planes > 1 else slice(None)] = part
    return out


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("packing", "predictor", "kind"), [(1, 1, "u2"), (8, 2, "u2"), (5, 1, "i2"), (5, 2, "u1"), (8, 3, "f4"), (1, 1, "f8")])
def test_tiff_layouts(order, packing, predictor, kind):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 200, (37, 41, 3)).astype(kind) if kind != "f4" else rng.random((37, 41, 3)).astype(kind)
    for big in (False, True):
        for tile in (None, (16, 32)):
            for planar in (1, 2):
                data = tiff(values, order, big, tile, packing, predictor, planar)
                assert np.array_equal(assembled(data), values)
                assert geotiff.profile(geotiff.tags(data)[1]) == (37, 41, 3, None, None, [3.0, 0.0, 500.0, 0.0, -2.0, 900.0])


def test_lzw_tables_fill_and_clear():
    data = np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8).tobytes() + b"abc" * 5000
    for some in (data, b"", b"a", b"ab" * 3000, bytes(100_000), data[:4000] * 3):
        assert geotiff.unpacked(packed_lzw(some)) == some == geotiff.unpacked(geotiff.packed(some)), len(some)
    with pytest.raises(ValueError, match="damaged"):
        geotiff.unpacked(b"\x80\x7f\xff\xff")


def test_tiff_refuses_what_it_does_not_know():
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.tags(b"PK\x03\x04")
    bad = tiff(np.zeros((3, 3, 1), "u2")).replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x01", b"\x03\x01\x03\x00\x01\x00\x00\x00\x07")
    with pytest.raises(ValueError, match="compression 7"):
        assembled(bad)
    whole = tiff(np.ones((30, 30, 2), "f4"), big=True, tile=(16, 16), packing=8)
    for cut in (3, 9, 15, len(whole) - 40):
        with pytest.raises(ValueError):
            geotiff.layout(*geotiff.tags(whole[:cut]))

"""The GeoTIFF source and sink: round trips, pruned blocks, damaged files, commits and aborts."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan

from rillgrid.sources import geotiff as g

HEIGHT, WIDTH = 70, 50


def pixels(spark, scenes=("a.tif", "b.tif")):
    """Two bands; col 3 is missing, and so is all of the block at rows 32 to 47, cols 32 to 47."""
    p = spark.range(HEIGHT * WIDTH).select(F.expr(f"cast(id div {WIDTH} as int)").alias("row"), F.expr(f"cast(id % {WIDTH} as int)").alias("col"))
    p = p.where("col <> 3 AND NOT (row >= 32 AND row < 48 AND col >= 32 AND col < 48)").withColumn("scene", F.explode(F.array(*(F.lit(s) for s in scenes))))
    return p.select("scene", "row", "col", (F.col("row") * 1.5 + F.col("col") + F.ascii("scene")).alias("v"), F.when((F.col("row") + F.col("col")) % 4 > 0, F.col("col") / 2).alias("w"))


@pytest.mark.parametrize("packing", [g.NONE, g.LZW, g.DEFLATE])
@pytest.mark.parametrize("planar", [False, True])
def test_pixels_come_back(spark, tmp_path, packing, planar):
    shape = g.Shape(HEIGHT, WIDTH, 2, 16, packing, planar, transform=(3.0, 0.0, 5e5, 0.0, -3.0, 4e6), epsg=32648)
    folder = f"file://{tmp_path}/out"
    g.write(pixels(spark), folder, shape, ["v", "w"])
    assert sorted(os.listdir(tmp_path / "out")) == ["a.tif", "b.tif"]
    want = {(r.scene, r.row, r.col, b): x for r in pixels(spark).collect() for b, x in ((1, r.v), (2, r.w)) if x is not None}
    back = g.read(spark, folder, layout="bands")
    assert {(r.scene, r.row, r.col, r.band): r.value for r in back.where("value IS NOT NULL").collect()} == want
    assert back.count() == 2 * 2 * HEIGHT * WIDTH
    if not planar:
        rows = g.read(spark, folder).where("bands[0] IS NOT NULL").collect()
        assert {(r.scene, r.row, r.col): r.bands[0] for r in rows} == {k[:3]: v for k, v in want.items() if k[3] == 1}
        literal = g.read(spark, folder, nodata="literal").where("col = 3").select("bands").distinct().collect()
        assert [r.bands for r in literal] == [[-9999.0, -9999.0]]
    meta = g.read_profiles(spark, folder).orderBy("scene").collect()
    assert [tuple(m) for m in meta] == [(s, HEIGHT, WIDTH, 2, -9999.0, "EPSG:32648", [3.0, 0.0, 5e5, 0.0, -3.0, 4e6]) for s in ("a.tif", "b.tif")]
    with open(tmp_path / "out/a.tif", "rb") as f:
        data = f.read()
    order, t = g.tags(data)
    assert data[:4] == b"II+\0" and t[g.TILE_WIDTH] == (16,) and t[g.COMPRESSION] == (packing,)
    gone = [k for k, n in enumerate(t[g.TILE_BYTES]) if n == 0]
    assert gone == ([2 * 4 + 2, 20 + 2 * 4 + 2] if planar else [2 * 4 + 2]) and len(data) == max(p + n for p, n in zip(t[g.TILES], t[g.TILE_BYTES], strict=True))


def planned(folder, *filters, **options):
    reader = g._Reader({"path": folder, "layout": "bands"} | options)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    parts = reader.partitions()
    return {(p.path.rpartition("/")[2], k) for p in parts for k, *_ in p.blocks}, parts


def test_filters_leave_blocks_unread(spark, tmp_path):
    folder = str(tmp_path / "out")
    g.write(pixels(spark), folder, g.Shape(HEIGHT, WIDTH, 2, 16, planar=True), ["v", "w"])
    every, _ = planned(folder)
    assert len(every) == 2 * 2 * 5 * 4
    row, col, band, scene = ("row",), ("col",), ("band",), ("scene",)
    few, _ = planned(folder, EqualTo(scene, "b.tif"), GreaterThanOrEqual(row, 20), LessThan(row, 32), EqualTo(col, 17), EqualTo(band, 2), IsNotNull(row))
    assert few == {("b.tif", 20 + 1 * 4 + 1)}
    assert planned(folder, GreaterThan(row, 200))[0] == set() and planned(folder, In(scene, ("c.tif",)))[0] == set()
    assert {k for _, k in planned(folder, In(col, (1, 40)), LessThan(row, 1))[0]} == {0, 1, 2, 20, 21, 22}
    assert g.read(spark, folder).where("row > 200").count() == 0
    assert max(len(p.blocks) for p in planned(folder, task_bytes=str(3 * 8 * 256))[1]) == 3
    # Through Spark: bytes outside the wanted block may be anything.
    with open(tmp_path / "out/b.tif", "r+b") as f:
        form, places, sizes = g.layout(*g.tags(f.read()))
        for k, (at, n) in enumerate(zip(places, sizes, strict=True)):
            if k != 20 + 1 * 4 + 1 and n:
                f.seek(at)
                f.write(b"\xff" * n)
    got = g.read(spark, folder, layout="bands").where("scene = 'b.tif' AND row >= 20 AND row < 32 AND col = 17 AND band = 2")
    assert {(r.row, r.value) for r in got.collect()} == {(r, 8.5 if (r + 17) % 4 else None) for r in range(20, 32)}


def test_damaged_files_are_rows(spark, tmp_path):
    folder = str(tmp_path / "out")
    g.write(pixels(spark, ("a.tif", "b.tif", "c.tif", "d.tif")), folder, g.Shape(HEIGHT, WIDTH, 2, 16), ["v", "w"])
    whole = (tmp_path / "out/b.tif").read_bytes()
    (tmp_path / "out/b.tif").write_bytes(whole[:200])
    (tmp_path / "out/c.tif").write_bytes(b"no raster")
    order, t = g.tags(data := (tmp_path / "out/d.tif").read_bytes())
    at = t[g.TILES][5]
    (tmp_path / "out/d.tif").write_bytes(data[:at] + struct.pack(">H", 0b100000000_0111111) + b"\xff" * (t[g.TILE_BYTES][5] - 2) + data[at + t[g.TILE_BYTES][5] :])
    out = g.read(spark, folder, errors="rows")
    bad = {r.scene: r.error for r in out.where("error IS NOT NULL").collect()}
    assert set(bad) == {"b.tif", "c.tif", "d.tif"} and "header" in bad["b.tif"] and "not a TIFF" in bad["c.tif"] and "LZW" in bad["d.tif"]
    assert {r.scene: r["count"] for r in out.where("error IS NULL").groupBy("scene").count().collect()} == {"a.tif": HEIGHT * WIDTH, "d.tif": HEIGHT * WIDTH - 256}
    with pytest.raises(Exception, match="b.tif"):
        g.read(spark, folder).count()


def test_commit_replaces_and_abort_leaves_nothing(spark, tmp_path):
    folder, shape = str(tmp_path / "out"), g.Shape(HEIGHT, WIDTH, 2, 16)
    g.write(pixels(spark, ("a.tif",)), folder, shape, ["v", "w"])
    before = (tmp_path / "out/a.tif").read_bytes()
    with pytest.raises(Exception, match="there already"):
        g.write(pixels(spark, ("a.tif", "b.tif")), folder, shape, ["w", "v"])
    assert os.listdir(folder) == ["a.tif"] and (tmp_path / "out/a.tif").read_bytes() == before
    g.write(pixels(spark, ("a.tif", "b.tif")), folder, shape, ["w", "v"], mode="overwrite")
    assert sorted(os.listdir(folder)) == ["a.tif", "b.tif"] and (tmp_path / "out/a.tif").read_bytes() != before
    # A task that fails ends the job: what others have written goes with the staging folder.
    rows = spark.range(40).select(F.concat(F.lit("z"), (F.col("id") % 8).cast("string")).alias("scene"), F.col("id").alias("place"), F.when(F.col("id") == 37, F.expr("cast(raise_error('lost') as binary)")).otherwise(F.lit(b"x")).alias("raw"))
    with pytest.raises(Exception, match="lost"):
        rows.repartition(8, "scene").sortWithinPartitions("scene", "place").write.format("geotiff").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["a.tif", "b.tif"]
    with pytest.raises(ValueError, match="outside"):
        g.write(pixels(spark), folder, g.Shape(HEIGHT, 10, 2, 16), ["v", "w"], mode="overwrite")
    # An attempt that does not count leaves no file.
    writer = g._Writer(folder, True)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"scene": ["q.tif"], "place": [0], "raw": [b"one"]})
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([second, None])
    assert sorted(os.listdir(folder)) == ["a.tif", "b.tif", "q.tif"] and first.names != second.names


def test_nothing_and_zeros(spark, tmp_path):
    folder = str(tmp_path / "none")
    g.write(pixels(spark).limit(0), folder, g.Shape(HEIGHT, WIDTH, 2, 16), ["v", "w"])
    assert os.listdir(folder) == [] and g.read(spark, folder).count() == 0
    form = g.layout(*g.tags(g.header(g.Shape(5, 5, 1, 16), {})))[0]
    assert np.array_equal(g.decoded(b"", 0, form), np.full((5, 5, 1), -9999.0, "f4"))


def test_lzw_of_long_and_short_words():
    """Runs, periods, noise and clearings come back, and packing finds the longest word of its table each time."""

    def plain(data):
        codes, table, word = [], {bytes([i]): i for i in range(256)}, b""
        for byte in data:
            if word + bytes([byte]) in table:
                word += bytes([byte])
                continue
            codes.append(table[word])
            table[word + bytes([byte])] = len(table) + 2
            word = bytes([byte])
            if len(codes) % g.MOST == 0:
                codes.append(g.CLEAR)
                table = {bytes([i]): i for i in range(256)}
        return [g.CLEAR, *codes, *([table[word]] if word else []), g.END]

    rng = np.random.default_rng(4)
    parts = [rng.integers(0, int(rng.choice([1, 2, 256])), int(rng.integers(0, 900)), dtype=np.uint8).tobytes() * int(rng.integers(1, 4)) for _ in range(60)]
    for data in [b"", b"a", bytes(200_000), np.full(9000, -9999.0, "<f4").tobytes(), rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes(), *parts, b"".join(parts)]:
        assert g.unpacked(g.packed(data)) == data
        codes, bits, held = plain(data), "".join(f"{b:08b}" for b in g.packed(data)), 0
        if len(codes) < 3000:
            for k, code in enumerate(codes):
                wide = min(12, max(9, (258 + max(0, k - 1)).bit_length()))
                assert int(bits[held : held + wide], 2) == code
                held += wide

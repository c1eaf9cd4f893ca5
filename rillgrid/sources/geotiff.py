"""GeoTIFF scenes as a Spark data source and sink (SRC-1…4, 14, 16; SNK-1, 2; CTL-4).

Reading: ``spark.read.format("geotiff")`` lists the files and reads their headers, then deals
blocks (tiles or strips) to tasks. Filters on scene, row, col and band that Spark pushes leave out
files and blocks before any of them is read; a task fetches the byte ranges of its own blocks only, so
files may have any size. With errors="rows" a damaged file or block is a row that says so, and the
others are read all the same.

Writing: pixels are dealt to blocks by one shuffle and packed by tasks. Offsets come from the blocks'
sizes, so a file's header is a row of its own; a task then writes the header and blocks of a file one after
another into a staging folder, and the driver, which sees names alone, moves the files into place when
all are there, or deletes the staging folder. Blocks without pixels are left out, as the format
allows; they read as nodata.

Files lie wherever pyarrow's file systems reach (local and shared folders, hdfs, s3, gs). Classic and big
files, strips and tiles, both planar layouts, whole and floating samples, no compression, LZW or
deflate, and the horizontal and floating predictors are understood; anything else is refused by name.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rillgrid.plans.session import written

# Numbers of the format's tags, and the letter and size of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
GEOGRAPHIC, PROJECTED = 2048, 3072  # keys of the reference system's number


class Profile(NamedTuple):
    height: int
    width: int
    bands: int
    nodata: float | None
    crs: str | None
    transform: list[float] | None  # x = a * col + b * row + c, y = d * col + e * row + f


Read = Callable[[int, int], bytes]  # (place, number of bytes)


def tags(source: bytes | Read) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image."""
    read = source if callable(source) else lambda at, n: source[at : at + n]

    def unpack(form: str, at: int) -> tuple:
        raw = read(at, struct.calcsize(form))
        if len(raw) < struct.calcsize(form):
            raise ValueError("the file ends inside its header")
        return struct.unpack(form, raw)

    start = read(0, 4)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack(order + "H", start[2:4])[0] if order and len(start) == 4 else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    at = unpack(order + ("Q" if big else "I"), 8 if big else 4)[0]
    n = unpack(order + ("Q" if big else "H"), at)[0]
    at += 8 if big else 2
    size, found = 20 if big else 12, {}
    if n > 4096:
        raise ValueError(f"{n} tags")
    entries = read(at, n * size)
    if len(entries) < n * size:
        raise ValueError("the file ends inside its header")
    for k in range(n):
        tag, type_, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), entries, k * size)
        if type_ in TYPES:
            form = f"{order}{count}{TYPES[type_]}"
            near = k * size + (12 if big else 8)
            if struct.calcsize(form) > (8 if big else 4):
                found[tag] = unpack(form, struct.unpack_from(order + ("Q" if big else "I"), entries, near)[0])
            else:
                found[tag] = struct.unpack_from(form, entries, near)
    for needed in (WIDTH, HEIGHT):
        if needed not in found:
            raise ValueError(f"no tag {needed}")
    return order, found


def profile(found: dict[int, tuple]) -> Profile:
    """What a file says of its grid."""
    transform = None
    if MATRIX in found:
        m = found[MATRIX]
        transform = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif SCALE in found and TIEPOINT in found:
        (sx, sy), (i, j, _, x, y) = found[SCALE][:2], found[TIEPOINT][:5]
        transform = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
    keys = found.get(GEOKEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
    text = found.get(NODATA, (b"",))[0].split(b"\0")[0].strip()
    return Profile(found[HEIGHT][0], found[WIDTH][0], found.get(SAMPLES, (1,))[0], float(text) if text else None, f"EPSG:{code}" if code else None, transform)


# --- LZW: codes of 9 to 12 bits, the highest bit first; 256 clears, 257 ends -----------------------

CLEAR, END, MOST = 256, 257, 3836  # MOST: codes between two clearings, when the table is full
_WIDTHS = np.array([min(12, max(9, (258 + i).bit_length())) for i in range(4096)])  # of the i-th code since a clearing
_STARTS = np.r_[0, np.cumsum(_WIDTHS)]

LONG = 16  # bytes of a word, beyond which packing looks words up whole


def unpacked(data: bytes) -> bytes:
    """What LZW packed: the codes up to each clearing are cut out of the bits together, then followed one by one."""
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    out, at, end = [], 0, 8 * len(data)
    while at < end:
        n = min(len(_WIDTHS), int(np.searchsorted(_STARTS, end - at, "right")) - 1)
        if n < 1:
            break
        places = at + _STARTS[:n]
        byte, bit = places >> 3, places & 7
        window = raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]
        codes = (window >> (32 - bit - _WIDTHS[:n]).astype(np.uint32)) & ((1 << _WIDTHS[:n]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        count = int(stop[0]) if len(stop) else n
        table, last = [bytes([i]) for i in range(256)] + [b"", b""], b""
        for code in codes[:count].tolist():
            if code < len(table):
                word = table[code]
            elif code == len(table) and last:
                word = last + last[:1]
            else:
                raise ValueError("damaged LZW data")
            out.append(word)
            if last:
                table.append(last + word[:1])
            last = word
        if not len(stop) or codes[count] == END:
            break
        at = int(places[count] + _WIDTHS[count])
    return b"".join(out)


def packed(data: bytes) -> bytes:
    """LZW of data, byte by byte; words of more than LONG bytes, such as those of nodata, are found by doubling and halving a length, as the table holds every beginning of its words."""
    codes, since, width_at = [CLEAR], [0], 0
    table, long, at, n, last = {}, {}, 0, len(data), 0
    while at < n:
        word, end = data[at], at + 1
        if long and data[at : at + LONG + 1] in long:
            low, step = LONG + 1, 1
            if last > low and at + last <= n:
                low, high = (last, n - at + 1) if data[at : at + last] in long else (low, last)
            else:
                high = n - at + 1
            while low + step < high and data[at : at + low + step] in long:
                low, step = low + step, 2 * step
            high = min(high, low + step)
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if data[at : at + middle] in long else (low, middle)
            word, end = long[data[at : at + low]], at + low
        while end < n and (known := table.get(word << 8 | data[end])) is not None:
            word, end = known, end + 1
        codes.append(word)
        since.append(width_at)
        width_at += 1
        last = end - at
        if end < n:
            table[word << 8 | data[end]] = 257 + width_at
            if last >= LONG:
                long[data[at : end + 1]] = 257 + width_at
            if width_at == MOST:
                codes.append(CLEAR)
                since.append(width_at)
                table, long, width_at = {}, {}, 0
        at = end
    codes.append(END)
    since.append(width_at)
    held, wide = np.array(codes, np.uint32), _WIDTHS[since]
    bits = np.concatenate([((np.repeat(h, w) >> _left(w).astype(np.uint32)) & 1).astype(np.uint8) for h, w in zip(np.array_split(held, len(held) // 4096 + 1), np.array_split(wide, len(held) // 4096 + 1), strict=True)])
    return np.packbits(bits).tobytes()


def _left(wide: np.ndarray) -> np.ndarray:
    """For each bit of codes of these widths, how many bits of its code come after it."""
    end = np.cumsum(wide)
    return np.repeat(end, wide) - np.arange(end[-1] if len(end) else 0) - 1


# --- blocks ---------------------------------------------------------------------------------------


class Layout(NamedTuple):
    """How a file's samples lie in blocks; block k is at row k // across % down, column k % across of plane k // (across * down)."""

    profile: Profile
    dtype: str
    packing: int
    predictor: int
    tiled: bool
    wide: int
    tall: int
    across: int
    down: int
    planes: int

    def place(self, k: int) -> tuple[int, int, int]:
        """Plane, first row and first column of block k."""
        return k // (self.across * self.down), k // self.across % self.down * self.tall, k % self.across * self.wide


def layout(order: str, t: dict[int, tuple]) -> tuple[Layout, tuple, tuple]:
    """A file's layout, and the places and sizes of its blocks."""
    p = profile(t)
    bits, packing, predictor, kind = t.get(BITS, (1,))[0], t.get(COMPRESSION, (NONE,))[0], t.get(PREDICTOR, (1,))[0], t.get(FORMAT, (1,))[0]
    if bits < 8 or packing not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2, 3) or kind not in (1, 2, 3):
        raise ValueError(f"bits {bits}, compression {packing}, predictor {predictor}, sample format {kind} are not supported")
    tiled, planes = TILES in t, p.bands if t.get(PLANAR, (1,))[0] == 2 else 1
    wide, tall = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (p.width, min(p.height, t.get(STRIP_ROWS, (p.height,))[0]))
    places, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    found = Layout(p, f"{order}{' uif'[kind]}{bits // 8}", packing, predictor, tiled, wide, tall, -(-p.width // wide), -(-p.height // tall), planes)
    if len(places) != len(sizes) or len(places) < found.planes * found.across * found.down:
        raise ValueError("blocks are missing from the header")
    return found, places, sizes


def decoded(raw: bytes, k: int, form: Layout) -> np.ndarray:
    """Block k's values (rows, cols, its plane's bands), without what lies beyond the image; an empty block is nodata, or 0."""
    _, row, col = form.place(k)
    rows, cols, samples = min(form.tall, form.profile.height - row), min(form.wide, form.profile.width - col), 1 if form.planes > 1 else form.profile.bands
    dtype, have = np.dtype(form.dtype), form.tall if form.tiled else rows
    if not raw:
        return np.full((rows, cols, samples), form.profile.nodata or 0, dtype.newbyteorder("="))
    try:
        raw = unpacked(raw) if form.packing == LZW else zlib.decompress(raw) if form.packing != NONE else raw
    except zlib.error as e:
        raise ValueError(f"damaged data: {e}") from e
    need = have * form.wide * samples
    if len(raw) < need * dtype.itemsize:
        raise ValueError(f"block {k} has {len(raw)} of {need * dtype.itemsize} bytes")
    if form.predictor == 3:
        b = np.cumsum(np.frombuffer(raw, np.uint8, need * dtype.itemsize).reshape(have, -1, samples), 1, np.uint8).reshape(have, dtype.itemsize, -1)
        part = np.ascontiguousarray(b.transpose(0, 2, 1)).view(np.dtype(f">f{dtype.itemsize}")).reshape(have, form.wide, samples)
    else:
        part = np.frombuffer(raw, dtype, need).reshape(have, form.wide, samples)
        part = np.cumsum(part, 1, dtype.newbyteorder("=")) if form.predictor == 2 else part
    return part[:rows, :cols].astype(dtype.newbyteorder("="))


# --- reading --------------------------------------------------------------------------------------


def _opened(path: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _read_at(path: str) -> tuple[Read, Callable[[], None]]:
    system, at = _opened(path)
    file = system.open_input_file(at)

    def read(place: int, n: int) -> bytes:
        return file.read_at(max(0, min(n, file.size() - place)), place) if place < file.size() else b""

    return read, file.close


@dataclass
class Wanted:
    """What pushed filters leave: ranges of row, col and band, both ends included, and names of scenes."""

    ranges: dict[str, list] = field(default_factory=lambda: {c: [0, 1 << 62] for c in ("row", "col", "band")})
    scenes: set | None = None

    def add(self, f: Filter) -> None:
        """Takes a filter into account if it is one of a column and a constant; others change nothing. Spark applies all of them again."""
        column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        value = getattr(f, "value", None)
        if column == "scene" and isinstance(f, EqualTo | EqualNullSafe | In):
            names = set(value) if isinstance(f, In) else {value}
            self.scenes = names if self.scenes is None else self.scenes & names
        if column in self.ranges:
            r = self.ranges[column]
            low = value if isinstance(f, GreaterThanOrEqual | EqualTo) else value + 1 if isinstance(f, GreaterThan) else min(value, default=0) if isinstance(f, In) else None
            high = value if isinstance(f, LessThanOrEqual | EqualTo) else value - 1 if isinstance(f, LessThan) else max(value, default=-1) if isinstance(f, In) else None
            self.ranges[column] = [max(r[0], r[0] if low is None else low), min(r[1], r[1] if high is None else high)]

    def blocks(self, form: Layout) -> list[int]:
        """The blocks with a pixel and a band (counted from 1) in range."""
        (r0, r1), (c0, c1), (b0, b1) = (self.ranges[c] for c in ("row", "col", "band"))
        planes = [p for p in range(form.planes) if form.planes == 1 or b0 <= p + 1 <= b1]
        rows = range(max(0, r0 // form.tall), min(form.down, r1 // form.tall + 1)) if r0 <= r1 else ()
        cols = range(max(0, c0 // form.wide), min(form.across, c1 // form.wide + 1)) if c0 <= c1 else ()
        return [(p * form.down + r) * form.across + c for p in planes for r in rows for c in cols]


class GeoTiffSource(DataSource):
    """format("geotiff"): path (a folder or a file); pattern of the names ("*.tif"); nodata: a number besides the file's own, or "literal"
    (T3); layout "pixels" (scene, row, col, bands) or "bands" (scene, row, col, band from 1, value); errors "raise", or "rows" with a
    column error; task_bytes: how many bytes of values a task reads, about (32 MB)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        by_band = self.options.get("layout", "pixels") == "bands"
        return "scene string, row int, col int, " + ("band int, value double" if by_band else "bands array<double>") + (", error string" if self.options.get("errors", "raise") == "rows" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Blocks(InputPartition):
    """Some blocks of one file, or of a file that cannot be read its error."""

    def __init__(self, path: str, form: Layout | None = None, blocks: list[tuple[int, int, int]] = (), error: str | None = None):
        self.path, self.form, self.blocks, self.error = path, form, blocks, error


def files(path: str, pattern: str = "*.tif") -> list[str]:
    """The files of a folder by name, or the file itself; hidden ones, and those being written, are left out."""
    from pyarrow import fs

    system, at = _opened(path)
    start = path[: len(path) - len(at)] if path.endswith(at) else ""
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(start + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif")
        self.nodata, self.by_band, self.rows_for_errors = options.get("nodata"), options.get("layout", "pixels") == "bands", options.get("errors", "raise") == "rows"
        self.task_bytes, self.wanted = int(options.get("task_bytes", 32 << 20)), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.wanted.add(f)
            yield f

    def partitions(self) -> list[_Blocks]:
        names = [f for f in files(self.path, self.pattern) if self.wanted.scenes is None or f.rpartition("/")[2] in self.wanted.scenes]
        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(self._of_file, names) for p in parts]

    def _of_file(self, path: str) -> list[_Blocks]:
        try:
            read, close = _read_at(path)
            try:
                form, places, sizes = layout(*tags(read))
            finally:
                close()
        except (ValueError, OSError, KeyError) as e:
            if not self.rows_for_errors:
                raise ValueError(f"{path}: {e}") from e
            return [_Blocks(path, error=str(e))]
        wanted = self.wanted.blocks(form)
        samples = 1 if form.planes > 1 else form.profile.bands
        each = max(1, self.task_bytes // (8 * samples * form.wide * form.tall))
        return [_Blocks(path, form, [(k, places[k], sizes[k]) for k in wanted[i : i + each]]) for i in range(0, len(wanted), each)]

    def read(self, part: _Blocks) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark gives where no block is wanted
            return
        scene = part.path.rpartition("/")[2]
        if part.error is not None:
            yield self._failed(scene, part.error)
            return
        read, close = _read_at(part.path)
        try:
            for k, place, size in part.blocks:
                try:
                    raw = read(place, size)
                    if len(raw) < size:
                        raise ValueError(f"block {k} ends after {len(raw)} of {size} bytes")
                    values = decoded(raw, k, part.form)
                except (ValueError, OSError) as e:
                    if not self.rows_for_errors:
                        raise ValueError(f"{part.path}: {e}") from e
                    yield self._failed(scene, str(e))
                    continue
                yield from self._rows(scene, k, values, part.form)
        finally:
            close()

    def _failed(self, scene: str, error: str) -> pa.RecordBatch:
        empty = [pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), *([pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64())] if self.by_band else [pa.nulls(1, pa.list_(pa.float64()))])]
        return self._batch([pa.array([scene]), *empty], error)

    def _batch(self, columns: list, error: str | None = None) -> pa.RecordBatch:
        names = ["scene", "row", "col", *(["band", "value"] if self.by_band else ["bands"]), *(["error"] if self.rows_for_errors else [])]
        return pa.RecordBatch.from_arrays(columns + ([pa.array([error] * len(columns[0]), pa.string())] if self.rows_for_errors else []), names=names)

    def _rows(self, scene: str, k: int, values: np.ndarray, form: Layout) -> Iterator[pa.RecordBatch]:
        plane, row, col = form.place(k)
        (r0, r1), (c0, c1), (b0, b1) = (self.wanted.ranges[c] for c in ("row", "col", "band"))
        values = values[max(0, r0 - row) : max(0, r1 - row + 1), max(0, c0 - col) : max(0, c1 - col + 1)].astype(float)
        row, col = max(row, r0), max(col, c0)
        rows, cols, bands = values.shape
        gone = np.isnan(values) | (values == form.profile.nodata if form.profile.nodata is not None else False)
        if self.nodata == "literal":
            gone = np.zeros(values.shape, bool)
        elif self.nodata is not None:
            gone |= values == float(self.nodata)
        at = pa.array(np.repeat(np.arange(row, row + rows, dtype=np.int32), cols)), pa.array(np.tile(np.arange(col, col + cols, dtype=np.int32), rows))
        names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(rows * cols, np.int32)), pa.array([scene])).dictionary_decode()
        if self.by_band:
            for b in range(bands):
                number = plane + 1 if form.planes > 1 else b + 1
                if b0 <= number <= b1:
                    yield self._batch([names, *at, pa.array(np.full(rows * cols, number, np.int32)), pa.array(values[:, :, b].ravel(), mask=gone[:, :, b].ravel())])
        else:
            yield self._batch([names, *at, pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, bands, dtype=np.int32)), pa.array(values.ravel(), mask=gone.ravel()))])


def register(spark: SparkSession) -> SparkSession:
    """Makes format("geotiff") known to the session, and lets it push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
    return spark


def read(spark: SparkSession, folder: str, pattern: str = "*.tif", nodata: float | str | None = None, **options) -> DataFrame:
    """SRC-1…4: (scene, row, col, bands) of all files; the file's nodata, the given one, and NaN are NULL, or stay with nodata="literal" (T3).

    Of files with separate planes, each row has the bands of one plane; layout="bands" names them instead.
    """
    given = {"pattern": pattern} | ({} if nodata is None else {"nodata": nodata}) | options
    return register(spark).read.format("geotiff").options(**given).load(folder)


def read_profiles(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """SRC-14: (scene, height, width, bands, nodata, crs, transform) of all files; tasks read headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                read, close = _read_at(path)
                try:
                    rows.append({"scene": path.rpartition("/")[2]} | profile(tags(read)[1])._asdict())
                finally:
                    close()
            yield pa.RecordBatch.from_pylist(rows, _PROFILE)

    names = spark.createDataFrame([(f,) for f in files(folder, pattern)], "path string")
    return names.repartition(max(1, min(200, names.count()))).mapInArrow(run, "scene string, height int, width int, bands int, nodata double, crs string, transform array<double>")


_PROFILE = pa.schema([("scene", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("bands", pa.int32()), ("nodata", pa.float64()), ("crs", pa.string()), ("transform", pa.list_(pa.float64()))])


# --- writing --------------------------------------------------------------------------------------


class Shape(NamedTuple):
    """What the files of a folder have in common."""

    height: int
    width: int
    bands: int
    tile: int = 512
    packing: int = LZW
    planar: bool = False  # a plane for each band, so that a band is read without the others
    nodata: float = -9999.0
    transform: tuple[float, ...] | None = None
    epsg: int | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.tile)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile)

    @property
    def blocks(self) -> int:
        return self.across * self.down * (self.bands if self.planar else 1)


def header(shape: Shape, sizes: dict[int, int]) -> bytes:
    """All of a big TIFF file that stands before its blocks, which follow in order; sizes: of the blocks that there are."""
    n = shape.blocks
    fields = [
        (WIDTH, "I", [shape.width]), (HEIGHT, "I", [shape.height]), (BITS, "H", [32] * shape.bands), (COMPRESSION, "H", [shape.packing]), (262, "H", [1]), (SAMPLES, "H", [shape.bands]), (PLANAR, "H", [2 if shape.planar else 1]),
        (TILE_WIDTH, "I", [shape.tile]), (TILE_HEIGHT, "I", [shape.tile]), (TILES, "Q", [0] * n), (TILE_BYTES, "Q", [sizes.get(k, 0) for k in range(n)]), (FORMAT, "H", [3] * shape.bands),
    ]
    if shape.transform is not None:
        a, b, c, d, e, f = shape.transform
        fields.append((MATRIX, "d", [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    if shape.epsg is not None:
        fields.append((GEOKEYS, "H", [1, 1, 0, 1, PROJECTED, 0, 1, shape.epsg]))
    fields.append((NODATA, "s", [f"{shape.nodata:.17g}".encode() + b"\0"]))
    numbers = {letter: type_ for type_, letter in TYPES.items() if type_ != 7}
    raw = {tag: content[0] if letter == "s" else struct.pack(f"<{len(content)}{letter}", *content) for tag, letter, content in fields}
    begin = 16 + 8 + 20 * len(fields) + 8
    end = begin + sum(len(x) for x in raw.values() if len(x) > 8)
    places, at = [], end
    for k in range(n):
        places.append(at if k in sizes else 0)
        at += sizes.get(k, 0)
    raw[TILES] = struct.pack(f"<{n}Q", *places)
    entries, far = b"", b""
    for tag, letter, content in fields:
        x = raw[tag]
        entries += struct.pack("<HHQ", tag, numbers[letter], len(x) if letter == "s" else len(content))
        entries += x.ljust(8, b"\0") if len(x) <= 8 else struct.pack("<Q", begin + len(far))
        far += x if len(x) > 8 else b""
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(fields)) + entries + bytes(8) + far


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceArrowWriter):
    """Writes rows (scene, place, raw), a scene's in order of place, as a file for each scene."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = _opened(self.staging)
        system.create_dir(folder, recursive=True)
        attempt, names, out = uuid.uuid4().hex, [], None
        try:
            for batch in batches:
                for scene, raw in zip(batch.column("scene").to_pylist(), batch.column("raw"), strict=True):
                    if not names or names[-1] != scene:
                        if out is not None:
                            out.close()
                        out = system.open_output_stream(f"{folder}/{scene}.{attempt}")
                        names.append(scene)
                    out.write(raw.as_buffer())
        finally:
            if out is not None:
                out.close()
        return _Written([f"{n}.{attempt}" for n in names])

    def commit(self, messages: list[_Written]) -> None:
        """Moves the files of the tasks that count into place; what others left goes with the staging folder."""
        from pyarrow import fs

        system, folder = _opened(self.path)
        _, staging = _opened(self.staging)
        moves = {n.rpartition(".")[0]: n for m in messages if m is not None for n in m.names}
        there = [] if self.overwrite else [i.path for i in system.get_file_info([f"{folder}/{n}" for n in moves]) if i.type != fs.FileType.NotFound]
        if there:
            self.abort(messages)
            raise ValueError(f"{len(there)} files are there already, such as {there[0]}")
        for final, name in moves.items():
            system.move(f"{staging}/{name}", f"{folder}/{final}")
        self._clear()

    def abort(self, messages: list[_Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staging = _opened(self.staging)
        try:
            system.delete_dir(staging)
        except FileNotFoundError:
            pass


def blocks(pixels: DataFrame, shape: Shape, values: Sequence[str], scene: str = "scene") -> DataFrame:
    """(scene, place, raw): the packed blocks that pixels (scene, row, col, values) fill; missing pixels and NaN are nodata. A group is one block's pixels."""
    names, samples = list(values), list(range(len(values)))
    if len(names) != shape.bands:
        raise ValueError(f"{len(names)} columns for {shape.bands} bands")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((shape.tile, shape.tile, shape.bands), shape.nodata, "<f4")
        grid[frame["row"].to_numpy() % shape.tile, frame["col"].to_numpy() % shape.tile] = frame[names].fillna(shape.nodata).to_numpy(np.float32)
        parts = [grid[:, :, b] for b in samples] if shape.planar else [grid]
        pack = {NONE: bytes, LZW: packed, DEFLATE: zlib.compress}[shape.packing]
        return pd.DataFrame({"scene": key[0], "place": [key[1] + b * shape.across * shape.down for b in range(len(parts))], "raw": [pack(p.tobytes()) for p in parts]})

    tile = F.lit(shape.tile)
    inside = pixels.where((F.col("row") >= 0) & (F.col("row") < shape.height) & (F.col("col") >= 0) & (F.col("col") < shape.width))
    place = (F.expr(f"row div {shape.tile}") * shape.across + F.expr(f"col div {shape.tile}")).cast("long")
    # As many tasks as the session names: a few pixels may make a large block, so Spark must not join partitions by their size.
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inside.select(F.col(scene).cast("string").alias("scene"), place.alias("place"), (F.col("row") % tile).cast("int").alias("row"), (F.col("col") % tile).cast("int").alias("col"), *(F.col(n).cast("double") for n in names)).repartition(n, "scene", "place").groupBy("scene", "place").applyInPandas(run, "scene string, place long, raw binary")


def write(pixels: DataFrame, folder: str, shape: Shape, values: Sequence[str], scene: str = "scene", mode: str = "append") -> None:
    """SNK-1, 2: a tiled big TIFF file of float samples in folder for each scene, named by it. Pixels outside the shape are an error.

    mode: "append" refuses to replace files, "overwrite" replaces those of the same name. Scenes without a pixel have no file.
    """
    spark = register(pixels.sparkSession)
    outside = pixels.where(~((F.col("row") >= 0) & (F.col("row") < shape.height) & (F.col("col") >= 0) & (F.col("col") < shape.width)) | F.col(scene).isNull())
    if not outside.isEmpty():
        raise ValueError(f"pixels outside {shape.height} rows and {shape.width} columns, or without a scene")
    packed_ = written(blocks(pixels, shape, values, scene), "blocks")

    def headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"scene": frame["scene"], "place": -1, "raw": [header(shape, {b["place"]: b["n"] for b in held}) for held in frame["held"]]})

    sizes = packed_.groupBy("scene").agg(F.collect_list(F.struct("place", F.octet_length("raw").alias("n"))).alias("held"))  # two numbers for each block of a file
    rows = sizes.mapInPandas(headers, "scene string, place long, raw binary").unionByName(packed_)
    system, at = _opened(folder)
    system.create_dir(at, recursive=True)
    rows.repartition("scene").sortWithinPartitions("scene", "place").write.format("geotiff").mode(mode).save(folder)

"""A Spark data source for plain raster files (SRC-1…4), one read task for each file and tile of rows.

It reads NumPy arrays (bands, rows, cols) or (rows, cols) saved as .npy, of either memory order. A task fetches
the byte ranges of its own rows, wherever pyarrow's file systems reach (local and shared folders, hdfs, s3, gs).
GeoTIFF: ``geotiff``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillgrid.sources.geotiff import _opened, files


class RasterSource(DataSource):
    """spark.read.format("raster").option("path", pattern).option("tile_rows", 512).load(); the pattern may stand in the last part of the path."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "scene string, row int, col int, bands array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Tile(InputPartition):
    """Rows first to last of a file: where its values begin, their kind, and (bands, rows, cols)."""

    def __init__(self, path: str, first: int, last: int, begin: int, kind: str, shape: tuple[int, int, int], by_column: bool):
        self.path, self.first, self.last, self.begin, self.kind, self.shape, self.by_column = path, first, last, begin, kind, shape, by_column


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.pattern, self.rows = options["path"], int(options.get("tile_rows", 512))

    def partitions(self) -> list[_Tile]:
        folder, _, pattern = self.pattern.rpartition("/")
        out = []
        for path in files(folder or "/", pattern):
            system, at = _opened(path)
            with system.open_input_file(at) as file:
                version = np.lib.format.read_magic(file)
                header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, by_column, kind = header(file)
                begin = file.tell()
            if len(shape) not in (2, 3) or kind.hasobject:
                raise ValueError(f"{path}: an array of {kind}, {shape}, is no raster")
            shape = (1, *shape)[-3:]
            out += [_Tile(path, r, min(r + self.rows, shape[1]), begin, kind.str, shape, by_column) for r in range(0, shape[1], self.rows)]
        return out

    def read(self, tile: _Tile) -> Iterator[pa.RecordBatch]:
        bands, height, width = tile.shape
        kind, rows = np.dtype(tile.kind), tile.last - tile.first
        outer, inner = (width, bands) if tile.by_column else (bands, width)  # the rows of each outer place lie together
        system, at = _opened(tile.path)
        with system.open_input_file(at) as file:
            parts = [file.read_at(rows * inner * kind.itemsize, tile.begin + (k * height + tile.first) * inner * kind.itemsize) for k in range(outer)]
        data = np.stack([np.frombuffer(p, kind).reshape(rows, inner) for p in parts]) if outer else np.empty((0, rows, inner), kind)
        data = data.transpose(2, 1, 0) if tile.by_column else data
        scene = tile.path.rpartition("/")[2].rpartition(".")[0]
        for r in range(rows):
            values = np.asarray(data[:, r, :], float).T.ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * bands + 1, bands, dtype=np.int32) if bands else np.zeros(width + 1, np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array([scene] * width), pa.array([tile.first + r] * width, pa.int32()), pa.array(np.arange(width, dtype=np.int32)), lists], names=["scene", "row", "col", "bands"])


def register(spark: SparkSession) -> None:
    """Makes format("raster") known to the session."""
    spark.dataSource.register(RasterSource)

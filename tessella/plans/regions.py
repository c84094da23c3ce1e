"""Pixels of rectangles that lie across native tiles: grid windows and free regions. Coordinates are shuffled, pixels never."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.cluster import spread, written
from tessella.functions.geometry import tiles_across
from tessella.operators import grid, jpeg
from tessella.sources import wsi


def decoded(data: bytes, tables: bytes, photometric: int) -> np.ndarray:
    """A tile as stored: YCbCr and RGB components untouched, others as RGB."""
    return jpeg.decode(jpeg.join_tables(tables, data), colour=photometric not in (2, 6))


def with_parts(rects: DataFrame, directory: DataFrame, keys: list[str]) -> DataFrame:
    """rects with parts, the stored tiles that each one meets; null where it lies outside of its level.

    rects: keys that tell its rows apart, path, ifd, x, y, w, h in level pixels, and the level's width, height, tile_w
    and tile_h. Tiles are found by generated numbers and an equi-join; a rectangle gathers as many as its area holds.
    """
    across, down = tiles_across("width", "tile_w"), tiles_across("height", "tile_h")
    met = grid.overlapped(rects, "x", "y", F.col("w"), F.col("h"), "tile_w", "tile_h", (across, down))
    met = met.withColumn("tile_index", F.col("native_y") * across + F.col("native_x")).join(directory, ["path", "ifd", "tile_index"])
    parts = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("native_y", "native_x", "offset", "byte_count"))).alias("parts"))
    return rects.join(parts, keys, "left")


class Stitcher:
    """Cuts rectangles out of stored tiles; each tile is decoded once for the rectangles of a chunk, in order of y."""

    def __init__(self):
        self.path, self.file, self.chunk, self.tiles = None, None, None, {}

    def __call__(self, t) -> np.ndarray:
        if t.path != self.path:
            self.close()
            self.path = t.path
        if self.chunk != (t.path, t.ifd, t.chunk):
            self.chunk, self.tiles = (t.path, t.ifd, t.chunk), {}
        self.tiles = {k: v for k, v in self.tiles.items() if k[0] >= t.y // t.tile_h}
        canvas = np.zeros((t.h, t.w, 3), np.uint8)
        for p in t.parts or ():
            ty, tx = p["native_y"], p["native_x"]
            if (ty, tx) not in self.tiles:
                self.tiles[ty, tx] = self.read(t, p)
            self.blit(canvas, t.x, t.y, self.tiles[ty, tx], tx * t.tile_w, ty * t.tile_h)
        return canvas

    def stored(self, t, offset: int | None = None, byte_count: int | None = None) -> np.ndarray:
        """A whole stored tile; without a place, the one of the row itself."""
        return decoded(self.raw(t, offset, byte_count), t.tables, t.photometric)

    def raw(self, t, offset: int | None = None, byte_count: int | None = None) -> bytes:
        if t.path != self.path:
            self.close()
            self.path = t.path
        if self.file is None:
            self.file = wsi.open_file(self.path)
        offset, byte_count = (t.offset, t.byte_count) if offset is None else (offset, byte_count)
        self.file.seek(offset)
        data = self.file.read(byte_count)
        if len(data) < byte_count:
            raise OSError(f"{t.path}: the tile at {offset} ends too early")
        return data

    def read(self, t, p) -> np.ndarray:
        """The part of a stored tile inside of the level, with three channels."""
        pixels = self.stored(t, p["offset"], p["byte_count"])[: t.height - p["native_y"] * t.tile_h, : t.width - p["native_x"] * t.tile_w]
        return np.repeat(pixels[..., None], 3, 2) if pixels.ndim == 2 else pixels

    @staticmethod
    def blit(canvas: np.ndarray, x: int, y: int, tile: np.ndarray, tile_x: int, tile_y: int) -> None:
        """Copies what a tile and a canvas that begins at x, y share."""
        x0, y0 = max(x, tile_x), max(y, tile_y)
        x1, y1 = min(x + canvas.shape[1], tile_x + tile.shape[1]), min(y + canvas.shape[0], tile_y + tile.shape[0])
        if x0 < x1 and y0 < y1:
            canvas[y0 - y : y1 - y, x0 - x : x1 - x] = tile[y0 - tile_y : y1 - tile_y, x0 - tile_x : x1 - tile_x]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file, self.chunk, self.tiles = None, None, None, {}


def read_regions(paths: DataFrame, regions: DataFrame) -> DataFrame:
    """The different regions of regions (path, level, x, y, w, h) with pixels: RGB bytes, row by row.

    What lies outside of the slide is black; a region without width or height has no bytes. Regions of slides that
    can't be read, of levels that a slide hasn't, and those with nulls or negative numbers are left out.
    """
    from tessella.plans import extraction

    images = written(wsi.ifds(paths), "images")
    keys = ["path", "level", "x", "y", "w", "h"]
    asked = regions.select("path", F.col("level").cast("int").alias("level"), *(F.col(c).cast("bigint").alias(c) for c in keys[2:])).distinct()
    lv = extraction.levels(wsi.slides(images)).select("path", "level", "width", "height", "tile_w", "tile_h", "photometric", "tables", "ifd")
    rects = asked.where(" and ".join(f"{c} >= 0" for c in keys[2:])).join(lv, ["path", "level"])
    whole = with_parts(rects.where("w > 0 and h > 0"), wsi.tile_directory(images), keys).withColumn("chunk", F.lit(0))
    names, kinds = [*keys, "pixels"], [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stitch = Stitcher()
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    t = SimpleNamespace(**batch.slice(i, 1).to_pylist()[0])
                    values = [*(getattr(t, c) for c in keys), stitch(t).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)
        finally:
            stitch.close()

    placed = spread(whole, "path", "level", (F.col("y") / 2048).cast("bigint"), (F.col("x") / 2048).cast("bigint")).sortWithinPartitions("path", "ifd", "y", "x")
    read = placed.mapInArrow(run, "path string, level int, x bigint, y bigint, w bigint, h bigint, pixels binary")
    return read.unionByName(rects.where("w = 0 or h = 0").select(*keys, F.lit(b"").alias("pixels")))

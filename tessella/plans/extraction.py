"""Extraction of native tiles from slides: coordinates are planned and filtered as rows before any pixel is read."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.cluster import spread, written
from tessella.functions import geometry, tags
from tessella.operators import grid, jpeg, raster
from tessella.options import Options
from tessella.plans.regions import Stitcher, decoded, with_parts
from tessella.sources import wsi

_LEVEL = "path string, slide string, level int, width int, height int, tile_w int, tile_h int, downsample double, photometric int, tables binary, ifd int"


def _tiles_of(level: DataFrame, directory: DataFrame) -> DataFrame:
    cells = grid.cells(level, geometry.tiles_across("width", "tile_w"), geometry.tiles_across("height", "tile_h"))
    cells = cells.withColumn("tile_index", F.col("tile_y") * geometry.tiles_across("width", "tile_w") + F.col("tile_x"))
    return cells.join(directory, ["path", "ifd", "tile_index"])


def levels(slides: DataFrame) -> DataFrame:
    fine = slides.where("error is null").select("path", "slide", "microns_per_pixel", F.size("levels").alias("n_levels"), F.explode("levels").alias("l"))
    return fine.select("path", "slide", "microns_per_pixel", "n_levels", "l.*")


def overviews(slides: DataFrame, directory: DataFrame) -> DataFrame:
    """The last level of each slide in gray (bytes, row by row), with its Otsu threshold."""
    last = levels(slides).where("level = n_levels - 1")
    tiles = _tiles_of(last, directory).select("path", "slide", "width", "height", "tile_w", "tile_h", "tile_x", "tile_y", "photometric", "tables", "offset", "byte_count")

    def stitch(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        out = {"path": [r.path], "ow": [r.width], "oh": [r.height], "overview": [None], "threshold": [None], "error": [None]}
        try:
            canvas = np.zeros((r.height, r.width), np.uint8)
            with wsi.open_file(r.path) as f:
                for t in frame.sort_values("offset").itertuples(index=False):
                    f.seek(t.offset)
                    part = raster.gray(decoded(f.read(t.byte_count), t.tables, t.photometric))
                    y, x = t.tile_y * t.tile_h, t.tile_x * t.tile_w
                    room = canvas[y : y + t.tile_h, x : x + t.tile_w]
                    room[:] = part[: room.shape[0], : room.shape[1]]
            out |= {"overview": [canvas.tobytes()], "threshold": [raster.otsu(np.bincount(canvas.reshape(-1), minlength=256))]}
        except Exception as e:  # a slide's failure is data: the others go on
            out["error"] = [f"{type(e).__name__}: {e}"]
        return pd.DataFrame(out)

    return tiles.groupBy("path").applyInPandas(stitch, "path string, ow int, oh int, overview binary, threshold int, error string")


def extract(paths: DataFrame, options: Options, raw: bool = False) -> DataFrame:
    """A row for each tile of the chosen level: slide, level, tile_x, tile_y, origin_x, origin_y, loc_x, loc_y, stage, kept, tissue_fraction, and width, height, jpeg of kept ones; or error.

    raw: the column jpeg holds the pixels instead, row by row, one or three bytes each.
    stage: 1 where the overview dropped a tile, 2 where its pixels did, null where it was kept. A slide's failure never
    ends the job: a slide that can't be read, that hasn't the level, or that has no microns per pixel where they are
    needed, is one row of its path's stem and error; a tile that can't be decoded is a row with its place and error.
    `summary` and `failures` tell them by slide. With tile_px the tiles are
    windows of tile_um microns, stride_um apart, cut across native tiles and resampled to tile_px; tile_x and tile_y are
    their column and row, and windows that would leave the level, or that have no microns per pixel, are none.
    """
    windowed = options.tile_px is not None
    images = written(wsi.ifds(paths), "images")  # tags are parsed once
    slides, directory = wsi.slides(images), wsi.tile_directory(images)
    lv = levels(slides).withColumn("level_mpp", F.col("microns_per_pixel") * F.col("downsample"))
    failed = _failed(slides, options)
    if options.level is not None:
        lv = lv.where(F.col("level") == options.level)
    else:
        best = grid.best_level(lv.select("path", "level", F.col("level_mpp").alias("mpp")), "path", F.lit(float(options.target_mpp)))
        lv = lv.join(best, "path").where("level = best_level")
    factor = F.lit(None).cast("double") if options.target_mpp is None else F.col("level_mpp") / float(options.target_mpp)
    tiles = _windows_of(lv, options) if windowed else _tiles_of(lv, directory).withColumns({
        "x": F.col("tile_x") * F.col("tile_w"), "y": F.col("tile_y") * F.col("tile_h"), "w": F.col("tile_w").cast("bigint"), "h": F.col("tile_h").cast("bigint"),
        "valid_w": geometry.valid_side("width", "tile_x", "tile_w"), "valid_h": geometry.valid_side("height", "tile_y", "tile_h"),
        "out_w": geometry.resized_side("tile_w", factor), "out_h": geometry.resized_side("tile_h", factor),
    })
    for a, side in (("x", "w"), ("y", "h")):
        tiles = tiles.withColumn(f"origin_{a}", geometry.base_pixels(a, "downsample"))
        tiles = tiles.withColumn(f"loc_{a}", F.col(f"origin_{a}") + geometry.int_div(geometry.base_pixels(side, "downsample"), 2))
    least = options.min_tissue_fraction
    if least is not None:
        shown = written(overviews(slides, directory), "overviews")
        failed = failed.unionByName(shown.where("error is not null").join(slides.select("path", "slide"), "path").select("slide", "error"))
        shown = shown.where("error is null")
        tiles = _first_stage(tiles, shown, least).join(shown.select("path", "threshold"), "path")
    else:
        tiles = tiles.withColumns({"first": F.lit(True), "threshold": F.lit(0), "overview_fraction": F.lit(None).cast("float")})
    target, quality, factors = options.stain_target, options.jpeg_quality, tags.CHROMA[options.chroma_subsampling.strip()]
    out = "slide string, level int, tile_x bigint, tile_y bigint, origin_x bigint, origin_y bigint, loc_x bigint, loc_y bigint, stage int, kept boolean, tissue_fraction float, width int, height int, jpeg binary, error string"

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "float": pa.float32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in out.split(", ")])

    def process(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stitch = Stitcher()
        for part in (p.slice(i, 64) for p in parts for i in range(0, p.num_rows, 64)):  # few tiles at once
            rows = []
            for t in (SimpleNamespace(**r) for r in part.to_pylist()):
                common = (t.slide, t.level, t.tile_x, t.tile_y, t.origin_x, t.origin_y, t.loc_x, t.loc_y)
                try:
                    pixels = stitch(t) if windowed else stitch.stored(t)
                except Exception as e:  # a tile's failure is data: the others go on
                    rows.append((*common, None, False, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                fraction = raster.tissue(pixels[: t.valid_h, : t.valid_w], t.threshold) if least is not None else None
                if least is not None and not fraction >= np.float32(least):
                    rows.append((*common, 2, False, fraction, None, None, None, None))
                    continue
                if target is not None:
                    pixels = raster.normalize(pixels, target)
                if (t.out_w, t.out_h) != (t.w, t.h):
                    pixels = raster.resize(pixels, t.out_w, t.out_h)
                rows.append((*common, None, True, fraction, pixels.shape[1], pixels.shape[0], pixels.tobytes() if raw else jpeg.encode(pixels, quality, factors, own_code=True), None))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        stitch.close()

    if windowed:
        wanted = with_parts(tiles.where("first"), directory, ["path", "tile_x", "tile_y"])
        read = spread(wanted, "path", "chunk").sortWithinPartitions("path", "chunk", "y", "x")
    else:
        read = spread(tiles.where("first"), "path", geometry.int_div(F.col("tile_y"), 8)).sortWithinPartitions("path", "offset")
    if options.tasks is not None:
        read = read.coalesce(options.tasks)
    kept = read.mapInArrow(process, out)
    none = {"stage": F.lit(1), "kept": F.lit(False), "tissue_fraction": F.col("overview_fraction"), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "jpeg": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")}
    dropped = tiles.where("not first").drop("width", "height").withColumns(none).select(*kept.columns)
    none = [F.lit(False).alias(c) if c == "kept" else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns if c not in ("slide", "error")]
    return kept.unionByName(dropped).unionByName(failed.select("slide", "error", *none).select(*kept.columns))


def stored_tiles(paths: DataFrame, level: int, decode: bool = True) -> DataFrame:
    """Every stored tile of a level, unfiltered and uncropped: path, slide, level, tile_x, tile_y, width, height, channels, data, error.

    data: the pixels row by row or, without decode, the bytes as stored (width, height and channels are then null). A
    slide without that level or that can't be read is one row with its error, and so is a tile that can't be decoded.
    """
    images = written(wsi.ifds(paths), "images")
    slides = wsi.slides(images)
    tiles = _tiles_of(levels(slides).where(F.col("level") == level), wsi.tile_directory(images))
    names = ["path", "slide", "level", "tile_x", "tile_y"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip([*names, "width", "height", "channels", "data", "error"], kinds, strict=True)))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stitch = Stitcher()
        for part in (p.slice(i, 64) for p in parts for i in range(0, p.num_rows, 64)):
            rows = []
            for t in (SimpleNamespace(**r) for r in part.to_pylist()):
                row = {n: getattr(t, n) for n in names}
                try:
                    if decode:
                        pixels = stitch.stored(t)
                        row |= {"height": pixels.shape[0], "width": pixels.shape[1], "channels": pixels.size // (pixels.shape[0] * pixels.shape[1]), "data": pixels.tobytes()}
                    else:
                        row["data"] = stitch.raw(t)
                except Exception as e:  # a tile's failure is data: the others go on
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)
        stitch.close()

    wanted = spread(tiles.select(*names, "photometric", "tables", "offset", "byte_count"), "path", geometry.int_div(F.col("tile_y"), 8)).sortWithinPartitions("path", "offset")
    out = wanted.mapInArrow(read, "path string, slide string, level int, tile_x bigint, tile_y bigint, width int, height int, channels int, data binary, error string")
    return out.unionByName(_failed(slides.withColumn("slide", F.struct("path", "slide")), Options(level=level)).select("slide.path", "slide.slide", "error"), allowMissingColumns=True)


def _failed(slides: DataFrame, options: Options) -> DataFrame:
    """(slide, error) of slides that can't be read or don't have what the options ask for."""
    wrong = F.col("error")
    if options.level is not None:
        wrong = F.coalesce(wrong, F.when(F.size("levels") <= options.level, F.concat(F.lit(f"OutOfBounds: level {options.level} of "), F.size("levels"))))
    if options.target_mpp is not None or options.tile_um is not None:
        wrong = F.coalesce(wrong, F.when(F.col("microns_per_pixel").isNull(), F.lit("InvalidMetadata: no microns per pixel")))
    return slides.select("slide", wrong.alias("error")).where("error is not null")


def _windows_of(level: DataFrame, options: Options) -> DataFrame:
    """Whole windows of each level; chunk numbers squares of 16 of them, whose native tiles one task decodes once."""
    px = lambda um: geometry.whole_pixels(F.lit(float(um)) / F.col("level_mpp"))
    sized = level.where("level_mpp is not null").withColumns({"w": px(options.tile_um), "stride": px(options.tile_um if options.stride_um is None else options.stride_um)})
    sized = sized.withColumns({"h": F.col("w"), "valid_w": F.col("w"), "valid_h": F.col("w"), "out_w": F.lit(options.tile_px), "out_h": F.lit(options.tile_px)})
    cells = grid.cells(sized, geometry.window_count("width", "w", "stride"), geometry.window_count("height", "w", "stride"))
    chunk = geometry.int_div("tile_y", 16) * (1 << 31) + geometry.int_div("tile_x", 16)
    return cells.withColumns({"x": F.col("tile_x") * F.col("stride"), "y": F.col("tile_y") * F.col("stride"), "chunk": chunk})


def _first_stage(tiles: DataFrame, shown: DataFrame, least: float) -> DataFrame:
    """first: whether the overview shows enough tissue in the tile's valid part. One overview a group, whatever its number of tiles."""
    spans = {}
    for a, side, own, over in (("x", "valid_w", "width", "ow"), ("y", "valid_h", "height", "oh")):
        spans[f"lo_{a}"], spans[f"hi_{a}"] = geometry.span(a, side, F.col(over).cast("double") / F.col(own).cast("double"), over)
    sized = tiles.join(shown.select("path", "ow", "oh"), "path").withColumns(spans)
    asked = sized.select("path", "tile_x", "tile_y", *spans)

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"path": [], "tile_x": [], "tile_y": [], "overview_fraction": []})
        r = right.iloc[0]
        dark = np.frombuffer(r.overview, np.uint8).reshape(r.oh, r.ow) <= r.threshold
        area = np.pad(dark.cumsum(0).cumsum(1), ((1, 0), (1, 0)))  # four look-ups a rectangle
        x0, x1, y0, y1 = (left[c].to_numpy() for c in ("lo_x", "hi_x", "lo_y", "hi_y"))
        n = area[y1, x1] - area[y0, x1] - area[y1, x0] + area[y0, x0]
        return left[["path", "tile_x", "tile_y"]].assign(overview_fraction=(n.astype(np.float32) / ((x1 - x0) * (y1 - y0)).astype(np.float32)))

    fractions = asked.groupBy("path").cogroup(shown.groupBy("path")).applyInPandas(measure, "path string, tile_x bigint, tile_y bigint, overview_fraction float")
    return tiles.join(fractions, ["path", "tile_x", "tile_y"]).withColumn("first", F.col("overview_fraction") >= F.lit(least).cast("float"))


def summary(events: DataFrame) -> DataFrame:
    """total, kept and dropped for each slide and, with a null slide, for all."""
    from tessella.operators import reports

    return reports.rollup(events.where("tile_x is not null and error is null"), "slide")


def failures(events: DataFrame) -> DataFrame:
    """(slide, error, n): each slide's different errors, and how many rows have them."""
    return events.where("error is not null").groupBy("slide", "error").agg(F.count(F.lit(1)).alias("n"))


def dataset_summary(events: DataFrame) -> DataFrame:
    """One row for the whole data set: total_slides, succeeded, failed, total, kept, dropped. A slide with any error has failed."""
    by = events.groupBy("slide").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.expr("tile_x is not null and error is null")).alias("total"), F.count_if(F.col("kept")).alias("kept"))
    n = lambda c, name: F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
    return by.agg(F.count(F.lit(1)).alias("total_slides"), F.count_if(F.col("errors") == 0).alias("succeeded"), F.count_if(F.col("errors") > 0).alias("failed"), n(F.sum("total"), "total"), n(F.sum("kept"), "kept"), n(F.sum(F.col("total") - F.col("kept")), "dropped"))

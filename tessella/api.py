"""Whole extractions in one call: one slide or a folder of slides, to files, counts or arrays."""

from __future__ import annotations

import time
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import errors, observers
from tessella.cluster import written
from tessella.operators import jpeg, raster
from tessella.options import Options, Outputs
from tessella.plans import extraction, report
from tessella.sinks import files
from tessella.sources import wsi


@dataclass(frozen=True)
class Dimensions:
    width: int
    height: int

    @property
    def pixels(self) -> int:
        return self.width * self.height

    @property
    def aspect_ratio(self) -> float:
        return float(np.float32(self.width) / np.float32(self.height))


@dataclass(frozen=True)
class Level:
    level: int
    dimensions: Dimensions
    tile: Dimensions
    downsample: float


@dataclass(frozen=True)
class Metadata:
    microns_per_pixel: float | None
    objective_power: float | None
    levels: tuple[Level, ...]

    @property
    def base(self) -> Level:
        return self.levels[0]

    def level(self, i: int) -> Level | None:
        return self.levels[i] if 0 <= i < len(self.levels) else None


@dataclass(frozen=True)
class Dataset:
    """What became of a folder: totals, and failures as rows (slide, error, n)."""

    total_slides: int
    succeeded: int
    total: int
    kept: int
    dropped: int
    failures: DataFrame


def uri(path: str) -> str:
    return path if "://" in path else Path(path).absolute().as_uri()


def metadata(spark: SparkSession, path: str) -> Metadata:
    """A slide's figures; raises what is wrong with it."""
    r = wsi.slides(wsi.ifds(wsi.from_paths(spark, [path]))).first()
    if r.error:
        raise errors.from_row(r.error)
    return Metadata(r.microns_per_pixel, r.objective_power, tuple(Level(x.level, Dimensions(x.width, x.height), Dimensions(x.tile_w, x.tile_h), x.downsample) for x in r.levels))


def read_tile(spark: SparkSession, path: str, level: int, tile_x: int, tile_y: int, decode: bool = True) -> np.ndarray | bytes:
    """One stored tile: its pixels or, without decode, its bytes."""
    found = metadata(spark, path).level(level)
    if found is None:
        raise errors.LevelOutOfBounds(f"level {level}")
    across, down = (-(-a // b) for a, b in ((found.dimensions.width, found.tile.width), (found.dimensions.height, found.tile.height)))
    if not (0 <= tile_x < across and 0 <= tile_y < down):
        raise errors.TileOutOfBounds(f"tile ({tile_x}, {tile_y}) of {across} x {down}")
    r = extraction.stored_tiles(wsi.from_paths(spark, [path]), level, decode).where((F.col("tile_x") == tile_x) & (F.col("tile_y") == tile_y)).first()
    if r is None:
        raise errors.InvalidMetadata(f"tile ({tile_x}, {tile_y}) isn't stored")
    if r.error:
        raise errors.from_row(r.error)
    if not decode:
        return bytes(r.data)
    return np.frombuffer(r.data, np.uint8).reshape((r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels))


def _one(spark: SparkSession, path: str, options: Options, raw: bool = False) -> DataFrame:
    """Written events of one slide; raises its first error."""
    events = written(extraction.extract(wsi.from_paths(spark, [path]), options, raw), "events")
    wrong = events.where("error is not null").orderBy("tile_y", "tile_x").select("error").first()
    if wrong:
        raise errors.from_row(wrong.error)
    return events


def extract(spark: SparkSession, path: str, outputs: Outputs | None = None, options: Options | None = None, **more) -> tuple[int, int]:
    """Extracts one slide to the files of outputs; gives (kept, total). Options are given whole or by their fields' names."""
    options, outputs, began = options or Options(**more), outputs or Outputs(), time.monotonic()
    events = _one(spark, path, options)
    kept = events.where("kept")
    if outputs.tile_dir is not None:
        files.write_jpegs(kept, uri(outputs.tile_dir), "{x}_{y}.jpg").collect()
    if outputs.tfrecord_file is not None:
        folder, _, name = uri(outputs.tfrecord_file).rpartition("/")
        files.write_tfrecords(kept, folder, name).collect()
    observers.tell(events, options.observers, options.min_tissue_fraction)
    total, n = events.agg(F.count(F.lit(1)), F.count_if("kept")).first()
    if outputs.report_path is not None:
        slide = events.select("slide").first()
        images = written(wsi.ifds(wsi.from_paths(spark, [path])), "images")
        _report(outputs.report_path, lambda out: report.write_slide(events, images, slide.slide if slide else Path(path).stem, options, time.monotonic() - began, out))
    return n, total


def extract_arrays(spark: SparkSession, path: str, options: Options | None = None, **more) -> list[tuple[int, int, np.ndarray]]:
    """Kept tiles of one slide as (tile_x, tile_y, h x w x 3), in order of rows, never encoded; for what fits in the driver. Gray becomes three equal channels."""
    events = _one(spark, path, options or Options(**more), raw=True)
    out = []
    for r in events.where("kept").select("tile_x", "tile_y", "width", "height", F.col("jpeg").alias("pixels")).orderBy("tile_y", "tile_x").toLocalIterator():
        pixels = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, -1)
        out.append((r.tile_x, r.tile_y, np.repeat(pixels, 3, 2) if pixels.shape[2] == 1 else pixels))
    return out


def extract_dataset(spark: SparkSession, folder: str, root: str, options: Options, tiles: bool = False, tfrecords: bool = True, tile_subdir: str | None = None, report_path: str | None = None) -> Dataset:
    """Extracts all slides of a folder to root/{slide}/...; one slide's failure ends no other. Slides of one name raise."""
    began = time.monotonic()
    paths = wsi.from_dir(spark, folder)
    files.check_stems(paths)
    events = written(extraction.extract(paths, options), "events")
    kept = events.where("kept")
    if tiles:
        files.write_jpegs(kept, uri(root), "{slide}/" + (f"{tile_subdir.strip('/')}/" if tile_subdir else "") + "{x}_{y}.jpg").write.format("noop").mode("overwrite").save()
    if tfrecords:
        files.write_tfrecords(kept, uri(root)).write.format("noop").mode("overwrite").save()
    observers.tell(events, options.observers, options.min_tissue_fraction)
    if report_path is not None:
        images = written(wsi.ifds(paths), "images")
        _report(report_path, lambda out: report.write_dataset(events, images, options, time.monotonic() - began, out))
    r = extraction.dataset_summary(events).first()
    return Dataset(r.total_slides, r.succeeded, r.total, r.kept, r.dropped, extraction.failures(events))


def stain_target(path: str, spark: SparkSession | None = None) -> tuple[float, ...]:
    """Means and deviations of Lab of a JPEG file, to normalise others to."""
    with wsi.open_file(path) as f:
        return raster.stain_stats(jpeg.decode(f.read(), True))


def _report(path: str, write) -> None:
    store, at = files.store_of(uri(path))
    try:
        with store.open_output_stream(at) as out:
            write(out)
    except OSError as e:
        raise errors.ReportError(f"{path}: {e}") from e

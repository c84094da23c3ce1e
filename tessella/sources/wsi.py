"""Slides as DataFrames: a folder is listed by Spark's file source, and each slide's tags are read where its path is."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.cluster import ship, spread
from tessella.errors import InvalidMetadata, UnsupportedFormat
from tessella.functions import tags
from tessella.sources import tiff

IFD = "ifd int, description string, width int, height int, tile_w int, tile_h int, photometric int, tables binary, offsets array<bigint>, counts array<bigint>"


def from_dir(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of a folder's .svs files in order, whatever the case of the extension; not of its subfolders, and without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][vV][sS]").option("recursiveFileLookup", "false").load(folder)
    return files.select("path").orderBy("path")


def from_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


def open_file(path: str):
    """A readable file of any store that pyarrow knows; plain paths are local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def images(path: str) -> list[dict]:
    with open_file(path) as f:
        found = tiff.directories(f)
    out = []
    for i, t in enumerate(found):
        if tiff.DESCRIPTION not in t:
            raise UnsupportedFormat(f"image {i} has no description")
        tile = (t[tiff.TILE_W][0], t[tiff.TILE_H][0]) if tiff.TILE_W in t and tiff.TILE_H in t else (None, None)
        row = {"ifd": i, "description": t[tiff.DESCRIPTION], "width": t[tiff.WIDTH][0], "height": t[tiff.HEIGHT][0], "tile_w": tile[0], "tile_h": tile[1], "photometric": t.get(tiff.PHOTOMETRIC, (None,))[0], "tables": t.get(tiff.TABLES), "offsets": list(t.get(tiff.OFFSETS, ())), "counts": list(t.get(tiff.COUNTS, ()))}
        if tile[0] is not None:
            if not row["offsets"] or not row["counts"] or not row["tables"] or row["photometric"] not in tags.PHOTOMETRIC:
                raise UnsupportedFormat(f"image {i} lacks tile offsets, byte counts, JPEG tables or a known photometric")
            if len(row["offsets"]) != len(row["counts"]):
                raise InvalidMetadata(f"image {i} has {len(row['offsets'])} offsets and {len(row['counts'])} byte counts")
            if t.get(tiff.COMPRESSION, (7,))[0] != 7:
                raise UnsupportedFormat(f"image {i} isn't JPEG-compressed")
        out.append(row)
    return out


def ifds(paths: DataFrame) -> DataFrame:
    """A row for each image of each slide; a slide that can't be read has one row with its error instead."""
    ship(paths.sparkSession)
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema([("path", pa.string()), ("error", pa.string()), *((c.split()[0], kinds[c.split()[1]]) for c in IFD.split(", "))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for path in part.column("path").to_pylist():
                try:
                    rows += [{"path": path, "error": None, **r} for r in images(path)]
                except Exception as e:  # a slide's failure is data: the others go on
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spread(paths.select("path"), "path").mapInArrow(run, f"path string, error string, {IFD}")


def slides(images_: DataFrame) -> DataFrame:
    """A row for each slide: objective_power and microns_per_pixel, each from the first image that has it, and levels in file order."""
    kind = tags.classify_ifd("description", F.col("tile_w").isNotNull())
    told = images_.withColumns({"kind": kind, "power": tags.described("description", "AppMag", "float"), "mpp": tags.described("description", "MPP", "double")})
    level = F.when((F.col("kind") == "PyramidLevel") & F.col("error").isNull(), F.struct("ifd", "width", "height", "tile_w", "tile_h", "photometric", "tables"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ifd")))
    base = F.min_by("width", "ifd").alias("base_width")
    out = told.groupBy("path").agg(first("power").alias("objective_power"), first("mpp").alias("microns_per_pixel"), F.array_sort(F.collect_list(level)).alias("found"), base, F.first("error", True).alias("error"))
    levels = F.transform("found", lambda x, i: F.struct(i.alias("level"), x["width"].alias("width"), x["height"].alias("height"), x["tile_w"].alias("tile_w"), x["tile_h"].alias("tile_h"), (F.col("base_width").cast("double") / x["width"].cast("double")).alias("downsample"), x["photometric"].alias("photometric"), x["tables"].alias("tables"), x["ifd"].alias("ifd")))
    none = F.when(F.col("error").isNull() & (F.size("found") == 0), F.lit("InvalidMetadata: no pyramid level"))
    return out.select("path", tags.stem("path").alias("slide"), "objective_power", "microns_per_pixel", levels.alias("levels"), F.coalesce("error", none).alias("error"))


def tile_directory(images_: DataFrame) -> DataFrame:
    """A row for each stored tile: path, ifd, tile_index, offset, byte_count."""
    tiled = images_.where("error is null and tile_w is not null").select("path", "ifd", F.posexplode(F.arrays_zip("offsets", "counts")).alias("tile_index", "x"))
    return tiled.select("path", "ifd", F.col("tile_index").cast("bigint").alias("tile_index"), F.col("x.offsets").alias("offset"), F.col("x.counts").alias("byte_count"))

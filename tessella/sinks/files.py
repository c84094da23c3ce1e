"""Tiles as files in a folder that all machines share, by default {slide}/{x}_{y}.jpg and {slide}/{slide}.tfrecord."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.cluster import ship
from tessella.errors import UnsupportedFormat
from tessella.functions import tags
from tessella.operators import jpeg
from tessella.sinks import tfrecord


def store_of(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def put(store, path: str, data: bytes, attempt: str) -> None:
    """Whole files only: written under the task's own name and moved."""
    store.create_dir(path.rpartition("/")[0])
    with store.open_output_stream(f"{path}.{attempt}") as out:
        out.write(data)
    store.move(f"{path}.{attempt}", path)


def named(pattern: str, **values: object) -> str:
    """pattern with {slide}, {x} and {y} replaced; any other brace stays."""
    for name, value in values.items():
        pattern = pattern.replace("{" + name + "}", str(value))
    return pattern


def check_stems(paths: DataFrame) -> None:
    """Raises where two slides have one stem and would write to the same files."""
    same = paths.groupBy(tags.stem("path").alias("slide")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("slide").limit(5).collect()
    if same:
        raise ValueError("slides of one name: " + ", ".join(f"{r.slide} ({r.n})" for r in same))


def save(pixels: np.ndarray, path: str, quality: int = 75) -> None:
    """One image as a file of the kind that its extension tells: jpg, jpeg or png."""
    kind = path.rpartition(".")[2].lower()
    if kind in ("jpg", "jpeg"):
        data = jpeg.encode(pixels, quality, own_code=True)
    elif kind == "png":
        rows = pixels.reshape(pixels.shape[0], -1)
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        lines = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes())  # each line after the number of its filter, none
        head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", lines) + chunk(b"IEND", b"")
    else:
        raise UnsupportedFormat(f"{path}: jpg, jpeg or png")
    with open(path, "wb") as out:
        out.write(data)


def write_jpegs(tiles: DataFrame, folder: str, name: str = "{slide}/{x}_{y}.jpg") -> DataFrame:
    """Writes slide, tile_x, tile_y, jpeg; gives (slide, files)."""
    ship(tiles.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, root = store_of(folder)
        for frame in frames:
            for r in frame.itertuples(index=False):
                put(store, f"{root}/{named(name, slide=r.slide, x=r.tile_x, y=r.tile_y)}", bytes(r.jpeg), str(TaskContext.get().taskAttemptId()))
            yield frame.groupby("slide").size().rename("files").reset_index()

    return tiles.select("slide", "tile_x", "tile_y", "jpeg").mapInPandas(run, "slide string, files bigint").groupBy("slide").sum("files").withColumnRenamed("sum(files)", "files")


def write_tfrecords(tiles: DataFrame, folder: str, name: str = "{slide}/{slide}.tfrecord") -> DataFrame:
    """Writes slide, tile_x, tile_y, jpeg, loc_x, loc_y, a file a slide in order of rows and columns, streamed; gives (slide, records)."""
    ship(tiles.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        (store, root), slide, out, n = store_of(folder), None, None, 0
        at = lambda: f"{root}/{named(name, slide=slide)}"
        attempt = str(TaskContext.get().taskAttemptId())

        def close() -> pd.DataFrame:
            out.close()
            store.move(f"{at()}.{attempt}", at())
            return pd.DataFrame({"slide": [slide], "records": [n]})

        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.slide != slide:
                    if out is not None:
                        yield close()
                    slide, n = r.slide, 0
                    store.create_dir(at().rpartition("/")[0])
                    out = store.open_output_stream(f"{at()}.{attempt}")
                out.write(tfrecord.frame(tfrecord.tile_example(r.slide, bytes(r.jpeg), int(r.loc_x), int(r.loc_y))))
                n += 1
        if out is not None:
            yield close()

    ordered = tiles.select("slide", "tile_x", "tile_y", "loc_x", "loc_y", "jpeg").repartition("slide").sortWithinPartitions("slide", "tile_y", "tile_x")
    return ordered.mapInPandas(run, "slide string, records bigint")


def write_manifest(tiles: DataFrame, folder: str) -> None:
    tiles.select("slide", "tile_x", "tile_y").write.csv(folder, header=True)

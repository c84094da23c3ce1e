"""Registered queries that go through real slide files: made from the supplier table, written, listed, parsed, decoded, encoded and read again."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.cluster import ship, shared_folder, spread, written
from tessella.operators import jpeg
from tessella.options import Options
from tessella.plans import extraction, regions
from tessella.plans import virtual as v
from tessella.plans.catalog import query
from tessella.sinks import files, tfrecord
from tessella.sources import tiff, wsi

SIDE, MPP = 16, 0.5
_SIZE = "select s_suppkey as k, 40 + s_suppkey % 17 as w, 24 + s_suppkey % 11 as h from supplier"
_TILES = f"s as ({_SIZE}), t as (select *, x::bigint as tile_x, y::bigint as tile_y, (37 * k + 53 * x + 29 * y) % 256 as g from s, unnest(range(0, (w + 15) // 16)) as a(x), unnest(range(0, (h + 15) // 16)) as b(y))"


@lru_cache(256)
def _flat(g: int) -> tuple[bytes, bytes]:
    """Tables and stored tile of one gray value: made slides have 256 different tiles."""
    return jpeg.split_tables(jpeg.encode(np.full((SIDE, SIDE, 3), g, np.uint8), 100, (1, 1), colour=False))


def slide_bytes(k: int) -> bytes:
    """Slide k: tiles of one gray value each on level 0, one tile on a level at a quarter, and a label."""
    w, h = 40 + k % 17, 24 + k % 11
    images = []
    for d, (width, height) in ((1, (w, h)), (4, (w // 4, h // 4))):
        across, down = -(-width // SIDE), -(-height // SIDE)
        grays = [(37 * k + 53 * x + 29 * y) % 256 for y in range(down) for x in range(across)]
        tables, tiles = None, []
        for g in grays:
            tables, tile = _flat(g)
            tiles.append(tile)
        told = f"Made|AppMag = 20|MPP = {MPP}" if d == 1 else "Made"
        images.append({"width": width, "height": height, "description": told, "tile": (SIDE, SIDE), "tiles": tiles, "tables": tables})
    images.append({"width": 8, "height": 8, "description": "a label"})
    return tiff.dumps(images)


def slide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a slide for each supplier, written once to the shared folder by the executors."""
    ship(spark)
    folder = f"{shared_folder(spark)}/slides-{uuid.uuid4().hex}"

    def run(parts):
        from pyspark import TaskContext

        store, root = files.store_of(folder)
        for part in parts:
            for k in part.column("k").to_pylist():
                files.put(store, f"{root}/{k}.svs", slide_bytes(k), str(TaskContext.get().taskAttemptId()))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{k}.svs" for k in part.column("k").to_pylist()])], ["path"])

    made = spread(v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return written(made.mapInArrow(run, "path string"), "paths")


def _seen(tiles: DataFrame) -> DataFrame:
    """The least and greatest value of each tile's jpeg."""
    names = ["slide", "tile_x", "tile_y", "loc_x", "loc_y", "width", "height"]

    def run(parts):
        for part in parts:
            pixels = [jpeg.decode(x, True) for x in part.column("jpeg").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array([int(f(p)) for p in pixels], pa.int32()) for f in (np.min, np.max))], [*names, "lo", "hi"])

    return tiles.select(*names, "jpeg").mapInArrow(run, "slide string, tile_x bigint, tile_y bigint, loc_x bigint, loc_y bigint, width int, height int, lo int, hi int")


@query(f"with {_TILES} select k::varchar as slide, tile_x, tile_y, tile_x * 16 + 8 as loc_x, tile_y * 16 + 8 as loc_y, 16::int as width, 16::int as height, g::int as lo, g::int as hi from t")
def svs_extract(spark, sf_dir):
    return _seen(extraction.extract(slide_files(spark, sf_dir), Options(level=0, jpeg_quality=100, chroma_subsampling="4:4:4")).where("kept"))


@query(f"with s as ({_SIZE}) select k::varchar as slide, x::bigint as tile_x, y::bigint as tile_y, x * 6 as origin_x, y * 6 as origin_y, 8::int as width, 8::int as height from s, unnest(range(0, (w - 8) // 6 + 1)) as a(x), unnest(range(0, (h - 8) // 6 + 1)) as b(y)")
def grid_extract(spark, sf_dir):
    events = extraction.extract(slide_files(spark, sf_dir), Options(level=0, tile_px=8, tile_um=8 * MPP, stride_um=6 * MPP))
    return events.where("kept").select("slide", "tile_x", "tile_y", "origin_x", "origin_y", "width", "height")


@query(f"""with s as ({_SIZE}), p as (select k, x, y, case when x < w and y < h then (37 * k + 53 * (x // 16) + 29 * (y // 16)) % 256 else 0 end as g
  from s, unnest(range(k % 30, k % 30 + 10 + k % 20)) as a(x), unnest(range(k % 20, k % 20 + 8 + k % 9)) as b(y))
select k::varchar as slide, count(*)::bigint as pixels, sum(g)::bigint as total from p group by k""")
def read_region(spark, sf_dir):
    from tessella.functions import tags

    paths = slide_files(spark, sf_dir)
    k = tags.stem("path").cast("bigint")
    asked = paths.select("path", F.lit(0).alias("level"), (k % 30).alias("x"), (k % 20).alias("y"), (k % 20 + 10).alias("w"), (k % 9 + 8).alias("h"))

    def run(parts):
        for part in parts:
            pixels = [np.frombuffer(x, np.uint8).reshape(-1, 3) for x in part.column("pixels").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("slide"), pa.array([len(p) for p in pixels], pa.int64()), pa.array([int(p[:, 1].sum()) for p in pixels], pa.int64())], ["slide", "pixels", "total"])

    return regions.read_regions(paths, asked).select(tags.stem("path").alias("slide"), "pixels").mapInArrow(run, "slide string, pixels bigint, total bigint")


@query(f"with {v.V_GRAY} select slide, tile_x, tile_y, 8::int as width, 8::int as height, true as close from v_gray group by all")
def jpeg_roundtrip(spark, sf_dir):
    ship(spark)
    e = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x.cast("double") * 256 + 128).cast("double"))).cast("int"))
    k = F.col("vec_id")
    tiles = v.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("slide"), (k % 8).alias("tile_x"), F.expr("(vec_id div 8) % 8").alias("tile_y"), e.alias("gray"))

    def run(parts):
        for part in parts:
            rows = [np.array(x, np.uint8).reshape(8, 8) for x in part.column("gray").to_pylist()]
            back = [jpeg.decode(jpeg.encode(x, 100)) for x in rows]
            sizes = [pa.array([b.shape[i] for b in back], pa.int32()) for i in (1, 0)]
            close = pa.array([bool(np.abs(a.astype(int) - b).max() <= 2) for a, b in zip(rows, back, strict=True)])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("slide", "tile_x", "tile_y")), *sizes, close], ["slide", "tile_x", "tile_y", "width", "height", "close"])

    return tiles.mapInArrow(run, "slide bigint, tile_x bigint, tile_y bigint, width int, height int, close boolean")


@query(f"with {_TILES} select k::varchar as slide, count(*)::bigint as records, sum(tile_x * 16 + 8)::bigint as sum_x, sum(tile_y * 16 + 8)::bigint as sum_y, min(g)::int as lo, max(g)::int as hi from t group by k")
def tfrecord_roundtrip(spark, sf_dir):
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    tiles = extraction.extract(slide_files(spark, sf_dir), Options(level=0, jpeg_quality=100, chroma_subsampling="4:4:4")).where("kept")
    done = written(files.write_tfrecords(tiles, folder), "records")

    def run(parts):
        store, root = files.store_of(folder)
        for part in parts:
            rows = []
            for slide in part.column("slide").to_pylist():
                with store.open_input_stream(f"{root}/{slide}/{slide}.tfrecord") as f:
                    found = [tfrecord.parse(x) for x in tfrecord.frames(f.read())]
                seen = [jpeg.decode(x["image_raw"], True) for x in found]
                if {x["slide"].decode() for x in found} != {slide}:
                    raise ValueError(f"records of other slides in {slide}")
                rows.append((slide, len(found), sum(x["loc_x"] for x in found), sum(x["loc_y"] for x in found), int(min(p.min() for p in seen)), int(max(p.max() for p in seen))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["slide", "records", "sum_x", "sum_y", "lo", "hi"])

    return spread(done.select("slide"), "slide").mapInArrow(run, "slide string, records bigint, sum_x bigint, sum_y bigint, lo int, hi int")

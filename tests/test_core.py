import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tessella.functions import geometry, tags
from tessella.operators import grid, jpeg, raster, reports, tissue
from tessella.options import Options
from tessella.plans import catalog, extraction, regions, volume  # noqa: F401
from tessella.sinks import files, tfrecord
from tessella.sources import tiff, wsi

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    duck.register("got", got)
    duck.execute("create or replace temp table want as " + catalog.ORACLE_SQL[name])
    columns = ", ".join(sorted(got.columns))
    assert sorted(x[0] for x in duck.execute("describe want").fetchall()) == sorted(got.columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert not duck.execute(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall()


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_geometry(spark):
    L = F.lit
    assert one(spark, *[geometry.window_count(L(a), L(b), L(c)) for a, b, c in ((900, 300, 300), (1000, 300, 300), (100, 300, 300), (1000, 300, 150))]) == (3, 3, 0, 5)
    assert one(spark, *[geometry.whole_pixels(L(x)) for x in (298.9, 297.9999999, 0.4)]) == (298, 298, 1)
    assert one(spark, geometry.valid_side(L(100), L(3), L(30)), geometry.valid_side(L(100), L(9), L(30)), geometry.tiles_across(L(2220), L(240))) == (10, 0, 10)
    assert one(spark, *geometry.fit_within(L(2.0), L(100.0), L(40.0)), *geometry.fit_within(L(0.5), L(100.0), L(40.0))) == (80, 40, 20, 40)
    assert one(spark, *[reports.unit_bin(L(x)).alias(f"b{i}") for i, x in enumerate((0, 0.05, 0.15, 0.95, 1, 0.7, 7, -1))]) == (0, 0, 1, 9, 9, 7, 9, 0)
    assert grid.cells(spark.range(1), L(0), L(3)).count() == 0


def test_otsu_and_levels(spark):
    rows = [("a", 50, 100), ("a", 200, 100), ("uniform", 9, 5)]
    got = {r["slide"]: r["threshold"] for r in tissue.otsu(spark.createDataFrame(rows, "slide string, intensity int, n bigint"), ["slide"]).collect()}
    assert got == {"a": 50, "uniform": 0}
    assert raster.otsu(np.bincount([50] * 100 + [200] * 100, minlength=256)) == 50 and raster.otsu(np.zeros(256, int)) == 0
    lv = spark.createDataFrame([("s", 0, 0.25), ("s", 1, 0.5), ("s", 2, 1.0), ("t", 0, None), ("u", 0, 0.5), ("u", 1, 0.5)], "slide string, level int, mpp double")
    for target, want in ((0.6, {"s": 1, "t": None, "u": 1}), (0.1, {"s": 0, "t": None, "u": 0})):
        assert {r["slide"]: r["best_level"] for r in grid.best_level(lv, "slide", F.lit(target)).collect()} == want


def test_overview_fractions(spark):
    rows = [("s", x, y, 50 if x < 5 else 230, 128) for x in range(10) for y in range(10)]
    over = spark.createDataFrame(rows, "slide string, ox bigint, oy bigint, g int, threshold int")
    rects = spark.createDataFrame([("s", 0, 0, 50, 100, 10, 10), ("s", 50, 0, 50, 100, 10, 10), ("s", 0, 0, 100, 100, 10, 10), ("none", 0, 0, 10, 10, 10, 10)], "slide string, x bigint, y bigint, w bigint, h bigint, sx int, sy int")
    got = sorted((r["slide"], r["x"], r["w"], r["overview_fraction"]) for r in tissue.overview_fraction(rects, over, ("sx", "sy"), (0.1, 0.1)).collect())
    assert got == [("none", 0, 10, 1.0), ("s", 0, 50, 1.0), ("s", 0, 100, 0.5), ("s", 50, 50, 0.0)]


def test_descriptions(spark):
    d = [("Lib|AppMag = 20|MPP = 0.4990|x",), ("MPP = 1|MPP = bad",), ("none",), ("| AppMag = 40 ",)]
    df = spark.createDataFrame(d, "description string").select(tags.described("description", "AppMag", "float"), tags.described("description", "MPP", "double"))
    assert [tuple(r) for r in df.collect()] == [(20.0, 0.499), (None, None), (None, None), (40.0, None)]
    p = spark.createDataFrame([("/a/b.c.svs",), ("b",), ("",), (".svs",)], "path string").select(tags.stem("path"))
    assert [r[0] for r in p.collect()] == ["b.c", "b", "slide", ".svs"]


def test_tfrecord():
    assert tfrecord.crc32c(b"123456789") == 0xE3069283 and tfrecord.crc32c(b"") == 0
    assert tfrecord.varint(300) == b"\xac\x02" and len(tfrecord.varint(-1)) == 10
    assert list(tfrecord.frames(tfrecord.frame(b"one") + tfrecord.frame(b""))) == [b"one", b""]


@pytest.mark.parametrize("factors", [(1, 1), (2, 1), (2, 2)])
def test_jpeg_round_trip(spark, tmp_path, factors):
    y, x = np.mgrid[0:48, 0:64]
    rgb = np.stack([4 * x, 5 * y, np.full_like(x, 128)], -1).astype(np.uint8)
    data = jpeg.encode(rgb, 95, factors)
    at = data.index(b"\xff\xc0")
    assert data[at + 11] == factors[0] << 4 | factors[1]
    assert np.abs(jpeg.decode(data, True).astype(int) - rgb).mean() < 4
    (tmp_path / "x.jpg").write_bytes(data)  # an independent decoder
    r = spark.read.format("image").load(str(tmp_path / "x.jpg")).select("image.*").first()
    other = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)[..., ::-1]
    assert np.abs(other.astype(int) - rgb).mean() < 4
    gray = (x + y).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(gray, 90)).astype(int) - gray).max() < 12


def test_raster(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (16, 16, 3), dtype=np.uint8)
    assert np.abs(raster.from_lab(raster.lab(x)).astype(int) - x).max() <= 1
    assert raster.resize(x, 8, 8).shape == (8, 8, 3) and (raster.resize(np.full((9, 7), 5, np.uint8), 3, 20) == 5).all()
    assert (raster.resize(x, 16, 16) == x).all()


def test_options():
    Options(level=0)
    for bad in ({}, {"level": 0, "target_mpp": 1.0}, {"level": 0, "tile_px": 5}, {"level": 0, "stride_um": 1.0}, {"level": 0, "jpeg_quality": 0}, {"level": 0, "chroma_subsampling": "4:1:1"}):
        with pytest.raises(ValueError):
            Options(**bad)


def slide(path, mpp="0.5"):
    """Two levels of 3 x 2 and 1 x 1 tiles of 32: the left tile columns dark, the rest bright; boundary tiles are padded."""
    images = []
    for d, (w, h) in ((1, (80, 50)), (4, (20, 12))):
        tiles = []
        for ty in range(-(-h // 32)):
            for tx in range(-(-w // 32)):
                px = (np.arange(32) + 32 * tx) * d
                tiles.append(jpeg.encode(np.repeat(np.where(px < 32, 40, 230)[None, :, None], 32, 0).repeat(3, 2).astype(np.uint8), 95, (1, 1), colour=False))
        cut = tiles[0].index(b"\xff\xda")
        start = [t.index(b"\xff\xc0") for t in tiles]
        tables = b"\xff\xd8" + tiles[0][2 : tiles[0].index(b"\xff\xee")] + tiles[0][tiles[0].index(b"\xff\xc4") : cut] + b"\xff\xd9"
        short = [b"\xff\xd8" + t[s : t.index(b"\xff\xc4")] + t[t.index(b"\xff\xda") :] for t, s in zip(tiles, start, strict=True)]
        images.append({"width": w, "height": h, "description": f"Lib|AppMag = 20{f'|MPP = {mpp}' if mpp and d == 1 else ''}", "tile": (32, 32), "tiles": short, "tables": tables})
    images.append({"width": 10, "height": 10, "description": "a label"})
    tiff.write(str(path), images)


def test_extraction(spark, tmp_path):
    slide(tmp_path / "a.svs")
    slide(tmp_path / "b.SVS")
    (tmp_path / "corrupt.svs").write_bytes(b"not a real tiff")
    (tmp_path / "notes.txt").write_text("x")
    paths = wsi.from_dir(spark, str(tmp_path))
    assert paths.count() == 3
    found = {r["slide"]: r for r in wsi.slides(wsi.ifds(paths)).collect()}
    assert found["corrupt"]["error"] and not found["a"]["error"]
    assert found["a"]["microns_per_pixel"] == 0.5 and found["a"]["objective_power"] == 20 and [x["downsample"] for x in found["a"]["levels"]] == [1.0, 4.0]
    every = extraction.extract(paths, Options(level=0)).collect()
    bad, every = [r for r in every if r["error"]], [r for r in every if not r["error"]]
    assert [(r["slide"], r["tile_x"], r["kept"]) for r in bad] == [("corrupt", None, False)] and "UnsupportedFormat" in bad[0]["error"]
    assert len(every) == 2 * 6 and all(r["kept"] and r["width"] == 32 for r in every)
    first = next(r for r in every if (r["slide"], r["tile_x"], r["tile_y"]) == ("a", 0, 0))
    assert np.abs(jpeg.decode(bytes(first["jpeg"]), True).astype(int) - 40).max() < 8 and (first["loc_x"], first["loc_y"]) == (16, 16)
    events = extraction.extract(paths, Options(target_mpp=1.0, min_tissue_fraction=0.5))
    rows = {(r["slide"], r["tile_x"], r["tile_y"]): r for r in events.collect() if not r["error"]}
    assert {k for k, r in rows.items() if r["kept"]} == {(s, 0, y) for s in "ab" for y in (0, 1)}
    assert {r["stage"] for r in rows.values() if not r["kept"]} == {1} and rows["a", 0, 0]["width"] == 16
    total = {r["slide"]: (r["total"], r["kept"], r["dropped"]) for r in extraction.summary(events).collect()}
    assert total == {"a": (6, 2, 4), "b": (6, 2, 4), None: (12, 4, 8)}
    kept = events.where("kept")
    assert {r["slide"]: r["records"] for r in files.write_tfrecords(kept, (tmp_path / "out").as_uri()).collect()} == {"a": 2, "b": 2}
    assert {r["slide"]: r["files"] for r in files.write_jpegs(kept, (tmp_path / "out").as_uri()).collect()} == {"a": 2, "b": 2}
    assert len(list(tfrecord.frames((tmp_path / "out/a/a.tfrecord").read_bytes()))) == 2
    assert sorted(p.name for p in (tmp_path / "out/a").iterdir()) == ["0_0.jpg", "0_1.jpg", "a.tfrecord"]


def test_regions_and_windows(spark, tmp_path):
    slide(tmp_path / "a.svs")
    (tmp_path / "corrupt.svs").write_bytes(b"not a real tiff")
    paths = wsi.from_dir(spark, str(tmp_path))
    a, gone = (next(p for (p,) in paths.collect() if p.endswith(x)) for x in ("a.svs", "corrupt.svs"))
    rects = [(0, 0, 0, 80, 50), (0, 20, 5, 30, 40), (0, 70, 40, 20, 20), (0, 500, 500, 4, 3), (1, 0, 0, 20, 12), (0, 3, 3, 0, 5), (0, 20, 5, 30, 40), (7, 0, 0, 4, 4)]
    asked = spark.createDataFrame([(a, *r) for r in rects] + [(gone, 0, 0, 0, 4, 4), (a, 0, None, 0, 4, 4)], "path string, level int, x int, y int, w int, h int")
    got = {(r["level"], r["x"], r["y"], r["w"], r["h"]): r["pixels"] for r in regions.read_regions(paths, asked).collect()}
    assert set(got) == set(rects[:6]) and len(got) == 6
    for (level, x, y, w, h), data in got.items():
        px = np.frombuffer(data, np.uint8).reshape(h, w, 3)
        size, d = ((80, 50), 1) if level == 0 else ((20, 12), 4)
        at = np.arange(x, x + w)
        inside = (at < size[0])[None, :] & (np.arange(y, y + h) < size[1])[:, None]
        want = np.where(inside, np.where(at * d < 32, 40, 230)[None, :], 0)[..., None]
        assert not w or np.abs(px.astype(int) - want).max() < 8

    def windows(**more):
        return {(r["tile_x"], r["tile_y"]): r for r in extraction.extract(paths, Options(level=0, jpeg_quality=95, **more)).where("error is null").collect()}

    same = windows(tile_px=32, tile_um=16.0)
    assert set(same) == {(0, 0), (1, 0)}  # whole windows only
    every = extraction.extract(paths, Options(level=0, jpeg_quality=95)).where("error is null").collect()
    for r in every:
        if (r["tile_x"], r["tile_y"]) in same:
            assert {k: r[k] for k in r.asDict()} == same[r["tile_x"], r["tile_y"]].asDict()
    some = windows(tile_px=10, tile_um=10.0, stride_um=5.0)
    assert set(some) == {(x, y) for x in range(7) for y in range(4)} and some[3, 1]["origin_x"] == 30 and some[3, 1]["loc_y"] == 20
    assert all(r["width"] == r["height"] == 10 for r in some.values())
    assert np.abs(jpeg.decode(bytes(some[1, 1]["jpeg"]), True).astype(int) - 40).max() < 10
    tissue_only = windows(tile_px=10, tile_um=10.0, stride_um=5.0, min_tissue_fraction=0.5)
    assert {k for k, r in tissue_only.items() if r["kept"]} == {(x, y) for x in (0, 1, 2) for y in range(4)} and len(tissue_only) == 28
    assert windows(tile_px=10, tile_um=100.0) == {}


@pytest.mark.parametrize("name", ["description", "tables", "counts"])
def test_bad_slides_are_rows(spark, tmp_path, name):
    image = {"width": 32, "height": 32, "description": "x", "tile": (32, 32), "tiles": [b"abcd"], "tables": b"\xff\xd8\xff\xd9"}
    image |= {"description": {"description": None}, "tables": {"tables": None}, "counts": {"counts": [4, 4]}}[name]
    tiff.write(str(tmp_path / "x.svs"), [image])
    assert wsi.ifds(wsi.from_paths(spark, [str(tmp_path / "x.svs")])).first()["error"]


def test_a_failure_ends_no_other_slide(spark, tmp_path):
    slide(tmp_path / "a.svs")
    slide(tmp_path / "b.svs")
    slide(tmp_path / "nompp.svs", mpp=None)
    (tmp_path / "corrupt.svs").write_bytes(b"not a real tiff")
    data = bytearray((tmp_path / "b.svs").read_bytes())
    begin = next(r["offset"] for r in wsi.tile_directory(wsi.ifds(wsi.from_paths(spark, [str(tmp_path / "b.svs")]))).collect() if r["ifd"] == 0 and r["tile_index"] == 4)
    data[begin : begin + 2] = b"xx"  # one tile of b
    data[begin + 2 : begin + 12] = b"\xff\xd9" * 5
    (tmp_path / "b.svs").write_bytes(data)
    paths = wsi.from_dir(spark, str(tmp_path))
    events = extraction.extract(paths, Options(level=0))
    assert {(r["slide"], r["n"]) for r in extraction.failures(events).collect()} == {("b", 1), ("corrupt", 1)}
    assert sum(r["kept"] for r in events.collect()) == 17
    assert extraction.dataset_summary(events).first().asDict() == {"total_slides": 4, "succeeded": 2, "failed": 2, "total": 17, "kept": 17, "dropped": 0}
    got = {r["slide"]: r["error"] for r in extraction.failures(extraction.extract(paths, Options(level=1, min_tissue_fraction=0.1))).collect()}
    assert set(got) == {"corrupt"}
    got = {r["slide"]: r["error"] for r in extraction.failures(extraction.extract(paths, Options(level=9))).collect()}
    assert got.keys() == {"a", "b", "nompp", "corrupt"} and got["a"] == "OutOfBounds: level 9 of 2"
    got = {r["slide"]: r["error"] for r in extraction.failures(extraction.extract(paths, Options(target_mpp=1.0))).collect()}
    assert got["nompp"].startswith("InvalidMetadata") and "a" not in got


def test_extraction_started_elsewhere(tmp_path):
    """Workers find the package though neither their folder nor PYTHONPATH has it."""
    import os
    import subprocess

    slide(tmp_path / "a.svs")
    code = f"""
import sys
sys.path.append({str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from tessella.options import Options
from tessella.plans import extraction
from tessella.sources import wsi
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", extraction.extract(wsi.from_dir(spark, {str(tmp_path)!r}), Options(level=0)).where("kept").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=240)
    assert "rows 6" in done.stdout, done.stderr[-2000:]


def test_a_watched_folder(spark, tmp_path):
    from tessella.streaming import extract_new

    (tmp_path / "in").mkdir()
    at = [(tmp_path / x).as_uri() for x in ("in", "out", "state")]
    for name in ("a", "b"):
        slide(tmp_path / f"in/{name}.svs")
        extract_new(spark, at[0], Options(level=0), *at[1:]).awaitTermination(120)
    rows = spark.read.parquet(at[1]).where("kept").groupBy("batch", "slide").count().collect()
    assert sorted(map(tuple, rows)) == [(0, "a", 6), (1, "b", 6)]

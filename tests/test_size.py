"""What keeps queries in proportion to their input on large tables: work dealt out before rows multiply, and no detour over all of them."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tessella.operators import grid
from tessella.plans import catalog, volume
from tessella.sources import wsi

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def dealt(spark, name: str) -> int:
    """The partitions that a query's rows really come from."""
    return catalog.QUERIES[name](spark, SF).select(F.spark_partition_id()).distinct().count()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_are_dealt_out_and_rounded_by_column_and_row(spark):
    assert dealt(spark, "tile_bounds_frac") > 1
    told = plan(catalog.QUERIES["tile_bounds_frac"](spark, SF)).splitlines()
    first = next(i for i, line in enumerate(told) if "Repartition" in line)
    assert [i for i, line in enumerate(told) if "round(" in line] == [i for i, line in enumerate(told) if "transform(" in line]  # not of each tile
    assert not any("transform(" in line for line in told[first:])  # nor in the task that reads the small table


def test_tiles_look_their_place_up_without_a_join(spark):
    df = catalog.QUERIES["tile_index_lookup"](spark, SF)
    assert "Join" not in plan(df) and dealt(spark, "tile_index_lookup") > 1
    tiles = spark.createDataFrame([(i, [7, None, 9], [1, 2]) for i in range(4)], "tile_index bigint, a array<bigint>, b array<bigint>")
    assert sorted(map(tuple, grid.looked_up(tiles, "tile_index", {"x": "a"}).select("tile_index", "x").collect())) == [(0, 7), (1, None), (2, 9)]
    assert grid.looked_up(tiles, "tile_index", {"x": "a", "y": "b"}).count() == 2


def test_origins_are_dealt_out(spark):
    assert dealt(spark, "tile_origins_centres") > 1
    told = plan(catalog.QUERIES["tile_origins_centres"](spark, SF))
    assert "Repartition" in told and "origin_x" in told[told.index("transform(") :]  # by column, not by tile


def test_windows_are_counted_side_by_side(spark):
    assert "Generate explode(sequence" not in plan(catalog.QUERIES["window_native_overlap"](spark, SF)) and dealt(spark, "window_native_overlap") > 1
    cases = [(n, w, s, t) for n in (1, 2, 7) for w in (1, 5, 16, 40) for s in (1, 4, 16, 50) for t in (1, 8, 16)]
    got = spark.createDataFrame(cases, "n bigint, w bigint, s bigint, t bigint").withColumn("m", grid.met_by("n", "w", "s", "t")).collect()
    for r in got:
        met = [range(i * r.s // r.t, (i * r.s + r.w - 1) // r.t + 1) for i in range(r.n)]
        assert (r.m.pairs, r.m.native_tiles) == (sum(map(len, met)), len({x for m in met for x in m}))


def test_valid_sizes_are_dealt_out(spark):
    assert dealt(spark, "valid_tile_dims") > 1
    told = plan(catalog.QUERIES["valid_tile_dims"](spark, SF))
    assert "valid_w" in told[told.index("transform(") :]


@pytest.mark.parametrize("name", ["tile_coords", "grid_windows"])
def test_coordinates_are_dealt_out(spark, name):
    assert dealt(spark, name) > 1


def test_made_slides_and_their_tags_are_dealt_out(spark):
    paths = volume.slide_files(spark, SF)
    assert paths.select(F.input_file_name()).distinct().count() > 1
    assert wsi.ifds(paths.coalesce(1)).select(F.spark_partition_id()).distinct().count() > 1


def test_regions_are_dealt_out(spark):
    assert dealt(spark, "read_region") > 1


def test_windows_are_dealt_out(spark):
    assert dealt(spark, "grid_extract") > 1


def test_stored_tiles_are_dealt_out(spark):
    assert dealt(spark, "svs_extract") > 1


def test_records_are_dealt_out(spark):
    assert dealt(spark, "tfrecord_roundtrip") > 1

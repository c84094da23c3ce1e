import io
import logging
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from test_core import slide, spark  # noqa: F401

from tessella import __main__, api, errors, observers
from tessella.operators import jpeg, raster
from tessella.options import Options, Outputs
from tessella.plans import extraction, report
from tessella.sinks import files, pdf, tfrecord
from tessella.sources import wsi


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("slides")
    slide(at / "a.svs")
    slide(at / "b.svs")
    (at / "corrupt.svs").write_bytes(b"not a real tiff")
    return at


def objects(data):
    """A PDF's objects by number, at the places that its table tells."""
    at = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n ", data[at:])]
    out = {}
    for i, p in enumerate(places, 1):
        assert data[p:].startswith(b"%d 0 obj\n" % i)
        out[i] = data[p : data.index(b"\nendobj\n", p)]
    return out


def test_metadata_and_stored_tiles(spark, folder):
    m = api.metadata(spark, str(folder / "a.svs"))
    assert (m.microns_per_pixel, m.objective_power) == (0.5, 20) and m.base.dimensions == api.Dimensions(80, 50) and m.level(1).downsample == 4 and m.level(2) is None
    assert m.base.dimensions.pixels == 4000 and abs(m.base.dimensions.aspect_ratio - 1.6) < 1e-6
    assert np.abs(api.read_tile(spark, str(folder / "a.svs"), 0, 2, 1).astype(int) - 230).max() < 8
    assert api.read_tile(spark, str(folder / "a.svs"), 0, 2, 1, decode=False)[:2] == b"\xff\xd8"
    for error, at in ((errors.LevelOutOfBounds, (2, 0, 0)), (errors.TileOutOfBounds, (0, 3, 0)), (IndexError, (0, 0, -1))):
        with pytest.raises(error):
            api.read_tile(spark, str(folder / "a.svs"), *at)
    with pytest.raises(errors.UnsupportedFormat):
        api.metadata(spark, str(folder / "corrupt.svs"))
    with pytest.raises(FileNotFoundError):
        api.metadata(spark, str(folder / "none.svs"))
    rows = extraction.stored_tiles(wsi.from_dir(spark, str(folder)), 0).collect()
    assert sorted((r.slide, r.tile_x, r.tile_y) for r in rows if not r.error) == [(s, x, y) for s in "ab" for x in range(3) for y in range(2)]
    assert [r.slide for r in rows if r.error] == ["corrupt"] and all(len(r.data) == 32 * 32 * 3 for r in rows if not r.error)


def test_one_slide_to_files(spark, folder, tmp_path, caplog):
    bar, counts = io.StringIO(), observers.Counts()
    o = Options(level=0).with_min_tissue_fraction(0.5).with_tasks(1).with_observer(observers.ProgressBar(bar)).with_observer(counts).with_logging()
    with caplog.at_level(logging.INFO, "tessella"):
        got = api.extract(spark, str(folder / "a.svs"), Outputs().with_tile_dir(str(tmp_path / "t")).with_tfrecord_file(str(tmp_path / "x.tfrecord")).with_report_path(str(tmp_path / "r.pdf")), o)
    assert got == (2, 6) == (counts.n_kept, counts.total) and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["0_0.jpg", "0_1.jpg"]
    assert len(list(tfrecord.frames((tmp_path / "x.tfrecord").read_bytes()))) == 2
    assert bar.getvalue().endswith("[" + "#" * 40 + "] 6/6\n") and "a: 2 of 6 tiles kept" in caplog.messages and sum("dropped" in m for m in caplog.messages) == 4
    found = objects((tmp_path / "r.pdf").read_bytes())
    assert sum(b"/Type /Page " in x for x in found.values()) == 1
    text = b"".join(found.values())
    assert b"(Tiles of a)" in text and b"(2 \\(33.3 %\\))" in text and b"(Tissue of dropped tiles)" in text and b"(\\(0, 1\\))" in text
    pictures = [jpeg.decode(x.split(b"stream\n", 1)[1].rsplit(b"\nendstream", 1)[0], True) for x in found.values() if b"/DCTDecode" in x]
    assert [p.shape for p in pictures] == [(12, 20, 3), (32, 32, 3), (32, 32, 3)]
    arrays = api.extract_arrays(spark, str(folder / "a.svs"), level=0, min_tissue_fraction=0.5)
    assert [(x, y, p.shape) for x, y, p in arrays] == [(0, 0, (32, 32, 3)), (0, 1, (32, 32, 3))] and np.abs(arrays[0][2].astype(int) - 40).max() < 8
    assert np.array_equal(arrays[1][2], api.read_tile(spark, str(folder / "a.svs"), 0, 0, 1))  # exactly as stored
    with pytest.raises(errors.UnsupportedFormat):
        api.extract(spark, str(folder / "corrupt.svs"), level=0)


def test_a_folder_by_command_line(spark, folder, tmp_path, capsys):
    args = ["dataset", str(folder), str(tmp_path / "out"), "--level", "0", "--min-tissue-fraction", "0.5", "--tiles", "--tile-subdir", "jpg", "--report", str(tmp_path / "r.pdf"), "-q"]
    assert __main__.main(args, spark) == 0
    assert capsys.readouterr().out.strip() == "2 of 3 slides succeeded, 4 tiles kept, 8 dropped."
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == [f"{s}/{x}" for s in "ab" for x in (f"{s}.tfrecord", "jpg/0_0.jpg", "jpg/0_1.jpg")]
    found = objects((tmp_path / "r.pdf").read_bytes())
    text = b"".join(found.values())
    assert sum(b"/Type /Page " in x for x in found.values()) == 2 and b"(corrupt: UnsupportedFormat: not a TIFF file)" in text and sum(b"/DCTDecode" in x for x in found.values()) == 2
    assert __main__.main(["extract", str(folder / "corrupt.svs"), "--level", "0", "-q", "--tfrecord-file", str(tmp_path / "c")], spark) == 1
    for bad in (["extract", "x"], ["extract", "x", "--level", "0", "--target-mpp", "1"], ["extract", "x", "--level", "0", "--threads", "2", "--sequential"]):
        with pytest.raises(SystemExit):
            __main__.parser().parse_args(bad)


def test_slides_of_one_name(spark):
    with pytest.raises(ValueError, match=r"a \(2\)"):
        files.check_stems(wsi.from_paths(spark, ["/x/a.svs", "/y/a.SVS", "/x/b.svs"]))


def test_codec_and_small_parts(tmp_path):
    rng = np.random.default_rng(3)
    for trial in range(40):
        h, w = rng.integers(1, 40, 2)
        im = rng.integers(0, 256, (h, w, 3) if trial % 2 else (h, w), dtype=np.uint8)
        im[: h * (trial % 3) // 2] = im.flat[0]
        for own in (False, True):
            assert np.abs(jpeg.decode(jpeg.encode(im, 100, (1, 1), own_code=own), True).astype(int) - im).max() <= 4
    y, x = np.mgrid[0:48, 0:64]
    rgb = np.stack([4 * x, 5 * y, (x * y) % 256], -1).astype(np.uint8)
    assert len(jpeg.encode(rgb, 95, (2, 2), own_code=True)) < len(jpeg.encode(rgb, 95, (1, 1), own_code=True)) < len(jpeg.encode(rgb, 95, (1, 1)))
    with pytest.raises(errors.UnsupportedFormat):
        jpeg.decode(jpeg.encode(rgb, 95)[:700])
    for n in (4095, 4096, 5000, 70_001):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert tfrecord.crc32c(data) == tfrecord._plain(data, 0xFFFFFFFF) ^ 0xFFFFFFFF
    assert raster.thumbnail(rgb, 32).shape == (24, 32, 3) and raster.thumbnail(rgb, 64) is rgb
    target = raster.stain_stats(rgb)
    assert len(target) == 6 and np.abs(raster.normalize(rgb, target).astype(int) - rgb).max() <= 1
    files.save(rgb, str(tmp_path / "a.PNG"))
    data = (tmp_path / "a.PNG").read_bytes()
    lines = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert np.array_equal(np.frombuffer(lines, np.uint8).reshape(48, 193)[:, 1:].reshape(48, 64, 3), rgb)
    files.save(rgb, str(tmp_path / "a.jpg"))
    assert api.stain_target(str(tmp_path / "a.jpg")) == raster.stain_stats(jpeg.decode((tmp_path / "a.jpg").read_bytes(), True))
    with pytest.raises(errors.UnsupportedFormat):
        files.save(rgb, str(tmp_path / "a.bmp"))
    assert isinstance(errors.from_row("TileOutOfBounds: x"), IndexError) and isinstance(errors.from_row("what: x"), errors.SlideError)
    import datetime

    assert report.utc_now(datetime.datetime(2024, 2, 29, 23, 59, 58, tzinfo=datetime.UTC)) == "2024-02-29 23:59:58 UTC"
    page = pdf.Page()
    page.text(1, 1, 9, "a(b)\\ 日")
    assert b"(a\\(b\\)\\\\ ?)" in page.ops[0]
    o = Options(level=1).with_target_mpp(2.0).with_jpeg_quality(900).with_grid_geometry(8, 4.0)
    assert (o.level, o.target_mpp, o.jpeg_quality, o.tile_px) == (None, 2.0, 100, 8) and o.with_level(3).target_mpp is None

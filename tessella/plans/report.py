"""PDF reports of extractions. Overviews are drawn where their tiles are read; the driver gets small JPEGs and counts, a slide at a time."""

from __future__ import annotations

import datetime
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import jpeg, raster, reports
from tessella.options import Options
from tessella.plans import extraction
from tessella.plans.regions import Stitcher
from tessella.sinks.pdf import MARGIN, PAGE_H, PAGE_W, Page, Writer
from tessella.sources import wsi

# Fixed values of the reports: longest side of an overview and of a sample in pixels, samples, bins, overviews a page.
OVERVIEW, SAMPLE, SAMPLES, BINS, A_PAGE = 1000, 256, 8, 10, 4
INK = (0, 150, 60)


def utc_now(at: datetime.datetime | None = None) -> str:
    return (at or datetime.datetime.now(datetime.UTC)).astimezone(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S UTC")


def overviews(images: DataFrame, events: DataFrame) -> DataFrame:
    """For each readable slide: base_w, base_h, microns_per_pixel, objective_power, n_levels, and its last level as a JPEG with the outlines of kept tiles: width, height, jpeg, or error.

    Every step-th pixel is taken, such that the longer side has at most 1,000: one small canvas for each slide.
    """
    slides = wsi.slides(images).where("error is null")
    base = slides.select("slide", "microns_per_pixel", "objective_power", F.size("levels").alias("n_levels"), F.col("levels")[0]["width"].alias("base_w"), F.col("levels")[0]["height"].alias("base_h"))
    last = extraction.levels(slides).where("level = n_levels - 1")
    tiles = extraction._tiles_of(last, wsi.tile_directory(images)).select("path", "slide", "width", "height", "tile_w", "tile_h", "tile_x", "tile_y", "photometric", "tables", "offset", "byte_count")
    tiles = tiles.join(base.select("slide", "base_w", "base_h"), "slide")
    boxes = events.where("kept").select("slide", "origin_x", "origin_y", (2 * (F.col("loc_x") - F.col("origin_x"))).alias("w"), (2 * (F.col("loc_y") - F.col("origin_y"))).alias("h"))

    def draw(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["slide", "width", "height", "jpeg", "overview_error"]
        if not len(left):
            return pd.DataFrame({c: [] for c in names})
        r, stitch = left.iloc[0], Stitcher()
        step = -(-int(max(r.width, r.height)) // OVERVIEW)
        canvas = np.full((-(-int(r.height) // step), -(-int(r.width) // step), 3), 255, np.uint8)
        try:
            for t in left.sort_values("offset").itertuples(index=False):
                x, y = t.tile_x * t.tile_w, t.tile_y * t.tile_h
                pixels = stitch.read(t, {"native_x": t.tile_x, "native_y": t.tile_y, "offset": t.offset, "byte_count": t.byte_count})
                pixels = pixels[-y % step :: step, -x % step :: step]
                canvas[-(-y // step) : -(-y // step) + pixels.shape[0], -(-x // step) : -(-x // step) + pixels.shape[1]] = pixels
        except Exception as e:  # a slide's failure is data: the others go on
            return pd.DataFrame([[r.slide, None, None, None, f"{type(e).__name__}: {e}"]], columns=names)
        finally:
            stitch.close()
        h, w = canvas.shape[:2]
        for origin_x, origin_y, bw, bh in right[["origin_x", "origin_y", "w", "h"]].itertuples(index=False):
            x0, x1 = (min(int(v * w / r.base_w), w - 1) for v in (origin_x, origin_x + bw))
            y0, y1 = (min(int(v * h / r.base_h), h - 1) for v in (origin_y, origin_y + bh))
            canvas[[y0, y1], x0 : x1 + 1] = INK
            canvas[y0 : y1 + 1, [x0, x1]] = INK
        return pd.DataFrame([[r.slide, w, h, jpeg.encode(canvas, 85, (1, 1), own_code=True), None]], columns=names)

    drawn = tiles.groupBy("slide").cogroup(boxes.groupBy("slide")).applyInPandas(draw, "slide string, width int, height int, jpeg binary, overview_error string")
    return base.join(drawn, "slide", "left")


def samples(events: DataFrame) -> DataFrame:
    """Up to 8 kept tiles of each slide, evenly spread in order of rows: slide, sample, tile_x, tile_y, width, height, jpeg of at most 256 pixels a side."""
    chosen = reports.systematic_sample(events.where("kept").select("slide", "tile_x", "tile_y"), ["slide"], ["tile_y", "tile_x"], SAMPLES)
    found = events.where("kept").select("slide", "tile_x", "tile_y", "jpeg").join(F.broadcast(chosen), ["slide", "tile_x", "tile_y"])  # 8 rows a slide

    def shrink(frames):
        for f in frames:
            small = [raster.thumbnail(jpeg.decode(bytes(x), True), SAMPLE) for x in f.jpeg]
            yield f.assign(width=[x.shape[1] for x in small], height=[x.shape[0] for x in small], jpeg=[jpeg.encode(x, 85, (1, 1), own_code=True) for x in small])[["slide", "sample", "tile_x", "tile_y", "width", "height", "jpeg"]]

    return found.mapInPandas(shrink, "slide string, sample int, tile_x bigint, tile_y bigint, width int, height int, jpeg binary")


def dropped_bins(events: DataFrame) -> DataFrame:
    """(slide, bin, n): tissue fractions of dropped tiles in ten equal bins."""
    lost = events.where("not kept and tissue_fraction is not null")
    return lost.groupBy("slide", reports.unit_bin(F.col("tissue_fraction"), BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _settings(o: Options) -> list[tuple[str, str]]:
    told = [("Level", str(o.level)) if o.level is not None else ("Target MPP", f"{o.target_mpp:g}")]
    told.append(("Least tissue", "none" if o.min_tissue_fraction is None else f"{o.min_tissue_fraction:.2f}"))
    told.append(("Stain normalisation", "no" if o.stain_target is None else "yes"))
    if o.tile_px is not None:
        told.append(("Grid", f"{o.tile_px} px of {o.tile_um:g} um, every {o.tile_um if o.stride_um is None else o.stride_um:g} um"))
    return [*told, ("JPEG", f"quality {o.jpeg_quality}, {o.chroma_subsampling}")]


def _table(page: Page, x: float, y: float, title: str, rows: list[tuple[str, str]]) -> float:
    page.text(x, y, 11, title)
    for i, (name, value) in enumerate(rows, 1):
        page.text(x, y + 5 * i, 9, name)
        page.text(x + 38, y + 5 * i, 9, value)
    return y + 5 * (len(rows) + 1)


def _bars(page: Page, x: float, y: float, w: float, h: float, title: str, counts: list[int], low: str, high: str) -> None:
    page.text(x, y, 11, title)
    each, most = w / len(counts), max(max(counts), 1)
    for i, n in enumerate(counts):
        tall = h * n / most
        page.box(x + i * each, y + 3 + h - tall, each * 0.9, tall, 0.45)
        if n:
            page.text(x + i * each, y + 2.5 + h - tall, 6, str(n))
    page.text(x, y + h + 7, 8, low)
    page.text(x + w - 10, y + h + 7, 8, high)


def _fitted(out: Writer, page: Page, row, x: float, y: float, w: float, h: float) -> float:
    """The row's image as large as fits into w x h; gives its height."""
    scale = min(w / row.width, h / row.height)
    page.image(out.jpeg(bytes(row.jpeg), row.width, row.height), x, y, row.width * scale, row.height * scale)
    return row.height * scale


def _share(part: int, whole: int) -> str:
    return f"{part} ({100 * part / whole:.1f} %)" if whole else str(part)


def write_slide(events: DataFrame, images: DataFrame, slide: str, options: Options, seconds: float, out: BinaryIO) -> None:
    """One page: header, settings, counts, overview with kept tiles, fractions of dropped tiles, samples. events and images are written tables."""
    own = events.where(F.col("slide") == slide)
    seen = overviews(images, own).where(F.col("slide") == slide).first()
    total, kept = own.where("tile_x is not null and error is null").agg(F.count(F.lit(1)), F.count_if("kept")).first()
    pdf, page = Writer(out), Page()
    page.text(MARGIN, MARGIN + 4, 16, f"Tiles of {slide}")
    told = f"{seen.base_w} x {seen.base_h} px, {seen.n_levels} levels" if seen else "unreadable"
    told += f", {seen.microns_per_pixel:g} um a pixel" if seen and seen.microns_per_pixel else ""
    told += f", {seen.objective_power:g}x" if seen and seen.objective_power else ""
    page.text(MARGIN, MARGIN + 10, 9, f"{told}; {utc_now()}")
    y = max(_table(page, MARGIN, 34, "Settings", _settings(options)), _table(page, 110, 34, "Tiles", [("Total", str(total)), ("Kept", _share(kept, total)), ("Dropped", _share(total - kept, total)), ("Seconds", f"{seconds:.1f}")]))
    if seen and seen.jpeg is not None:
        y += 4 + _fitted(pdf, page, seen, MARGIN, y + 4, PAGE_W - 2 * MARGIN, 110)
    counts = {r.bin: r.n for r in dropped_bins(own).collect()}
    if counts:
        _bars(page, MARGIN, y + 10, PAGE_W - 2 * MARGIN, 28, "Tissue of dropped tiles", [counts.get(i, 0) for i in range(BINS)], "0.0", "1.0")
        y += 50
    few = sorted(samples(own).collect(), key=lambda r: r.sample)
    for i, r in enumerate(few):
        at = MARGIN + i * 22.5
        _fitted(pdf, page, r, at, y + 8, 20, 20)
        page.text(at, y + 32, 7, f"({r.tile_x}, {r.tile_y})")
    pdf.add(page)
    pdf.close()


def write_dataset(events: DataFrame, images: DataFrame, options: Options, seconds: float, out: BinaryIO) -> None:
    """A summary with counts, kept tiles by slide and failures, then four overviews a page. Slides with an error are told as failures only."""
    wrong = extraction.failures(events)
    all_ = extraction.dataset_summary(events).first()
    pdf, page = Writer(out), Page()
    page.text(MARGIN, MARGIN + 4, 16, "Tiles of a data set")
    page.text(MARGIN, MARGIN + 10, 9, utc_now())
    told = [("Slides", str(all_.total_slides)), ("Succeeded", str(all_.succeeded)), ("Failed", str(all_.failed)), ("Tiles kept", _share(all_.kept, all_.total)), ("Tiles dropped", _share(all_.dropped, all_.total)), ("Seconds", f"{seconds:.1f}")]
    y = max(_table(page, MARGIN, 34, "Settings", _settings(options)), _table(page, 110, 34, "Results", told))
    good = extraction.summary(events).where("slide is not null").join(wrong.select("slide").distinct(), "slide", "left_anti")
    if all_.succeeded:
        counts = {r.bin: r.n for r in reports.range_bins(good, "kept", BINS).collect()}
        low, high = good.agg(F.min("kept"), F.max("kept")).first()
        if counts:
            _bars(page, MARGIN, y + 8, PAGE_W - 2 * MARGIN, 30, "Slides by kept tiles", [counts.get(i, 0) for i in range(BINS)], str(low), str(high))
            y += 52
    if all_.failed:
        page.text(MARGIN, y, 11, "Failures")
        for r in wrong.orderBy("slide", "error").toLocalIterator():
            y += 5
            if y > PAGE_H - MARGIN:
                pdf.add(page)
                page, y = Page(), MARGIN + 5
            page.text(MARGIN, y, 8, f"{r.slide}: {r.error}"[:120])
    pdf.add(page)
    place = 0
    for r in overviews(images, events).join(good, "slide").orderBy("slide").toLocalIterator():
        if place % A_PAGE == 0:
            page = Page()
        x, y = MARGIN + place % 2 * 92, MARGIN + place // 2 % 2 * 135
        page.text(x, y + 4, 10, r.slide)
        page.text(x, y + 9, 8, f"{_share(r.kept, r.total)} kept of {r.total}")
        if r.jpeg is not None:
            _fitted(pdf, page, r, x, y + 12, 87, 115)
        place += 1
        if place % A_PAGE == 0:
            pdf.add(page)
    if place % A_PAGE:
        pdf.add(page)
    pdf.close()

"""Observers of extractions. Event rows without pixels are brought to the driver a partition at a time, so memory is bounded."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame


class Observer:
    """Told, for each slide, of its start, of every tile, and of its end; any of the four may be left as it is.

    kept and dropped are told with the event's row: slide, level, tile_x, tile_y, origin_x, origin_y, stage, tissue_fraction.
    """

    def started(self, slide: str, level: int | None, total: int) -> None:
        pass

    def dropped(self, tile, least: float | None) -> None:
        pass

    def kept(self, tile) -> None:
        pass

    def completed(self, slide: str, total: int, kept: int) -> None:
        pass


class Counts(Observer):
    """How many tiles there were, and how many were kept."""

    def __init__(self):
        self.total = self.lost = 0

    def started(self, slide, level, total):
        self.total += total

    def dropped(self, tile, least):
        self.lost += 1

    @property
    def n_kept(self) -> int:
        return self.total - self.lost


class Logging(Observer):
    def __init__(self, logger: logging.Logger | None = None):
        self.log = logger or logging.getLogger("tessella")

    def started(self, slide, level, total):
        self.log.info("%s: %d tiles at level %s", slide, total, level)

    def dropped(self, tile, least):
        self.log.info("%s: tile (%d, %d) dropped, tissue %.3f of %.3f", tile.slide, tile.tile_x, tile.tile_y, tile.tissue_fraction, least)

    def kept(self, tile):
        self.log.debug("%s: tile (%d, %d) kept", tile.slide, tile.tile_x, tile.tile_y)

    def completed(self, slide, total, kept):
        self.log.info("%s: %d of %d tiles kept", slide, kept, total)


class ProgressBar(Observer):
    def __init__(self, out=None, width: int = 40):
        self.out, self.width = out or sys.stderr, width
        self.done = self.total = 0
        self.shown = -1

    def started(self, slide, level, total):
        self.done, self.total, self.shown = 0, total, -1

    def _one(self) -> None:
        self.done += 1
        filled = self.width * self.done // max(self.total, 1)
        if filled != self.shown or self.done == self.total:
            self.shown = filled
            self.out.write(f"\r[{'#' * filled}{'.' * (self.width - filled)}] {self.done}/{self.total}")

    def dropped(self, tile, least):
        self._one()

    def kept(self, tile):
        self._one()

    def completed(self, slide, total, kept):
        self.out.write("\n")
        self.out.flush()


def tell(events: DataFrame, observers: tuple[Observer, ...], least: float | None = None) -> None:
    """Tells observers, in their order, of events that have been written; slides and their tiles come in order."""
    from tessella.plans.extraction import summary

    if not observers:
        return
    tiles = events.where("tile_x is not null and error is null").select("slide", "level", "tile_x", "tile_y", "origin_x", "origin_y", "stage", "kept", "tissue_fraction")
    counts = summary(events).where("slide is not null").withColumnRenamed("kept", "n_kept").select("slide", "total", "n_kept")
    slide = None
    for r in tiles.join(counts, "slide").orderBy("slide", "tile_y", "tile_x").toLocalIterator():
        if slide is None or r.slide != slide.slide:
            if slide is not None:
                for o in observers:
                    o.completed(slide.slide, slide.total, slide.n_kept)
            slide = r
            for o in observers:
                o.started(r.slide, r.level, r.total)
        for o in observers:
            if r.kept:
                o.kept(r)
            else:
                o.dropped(r, least)
    if slide is not None:
        for o in observers:
            o.completed(slide.slide, slide.total, slide.n_kept)

"""Options of an extraction."""

from __future__ import annotations

from dataclasses import dataclass, replace

from tessella.functions.tags import CHROMA


@dataclass(frozen=True)
class Options:
    """Exactly one of level and target_mpp; a grid needs tile_px and tile_um, and stride_um defaults to tile_um.

    tasks: at most so many tasks read tiles at once (1: one after another); null leaves that to Spark. observers are told
    of an extraction by `api`; extract itself only gives rows.
    """

    level: int | None = None
    target_mpp: float | None = None
    min_tissue_fraction: float | None = None
    stain_target: tuple[float, ...] | None = None
    tile_px: int | None = None
    tile_um: float | None = None
    stride_um: float | None = None
    jpeg_quality: int = 75
    chroma_subsampling: str = "4:2:0"
    tasks: int | None = None
    observers: tuple = ()

    def __post_init__(self):
        if (self.level is None) == (self.target_mpp is None):
            raise ValueError("give exactly one of level and target_mpp")
        if (self.tile_px is None) != (self.tile_um is None):
            raise ValueError("tile_px and tile_um go together")
        if self.stride_um is not None and self.tile_um is None:
            raise ValueError("stride_um needs tile_px and tile_um")
        if not 1 <= self.jpeg_quality <= 100:
            raise ValueError("jpeg_quality is 1 to 100")
        if self.chroma_subsampling.strip() not in CHROMA:
            raise ValueError(f"chroma_subsampling is one of {', '.join(CHROMA)}")
        if self.tasks is not None and self.tasks < 1:
            raise ValueError("tasks is at least 1")

    def with_level(self, level: int) -> Options:
        """The last of with_level and with_target_mpp wins."""
        return replace(self, level=level, target_mpp=None)

    def with_target_mpp(self, target_mpp: float) -> Options:
        return replace(self, level=None, target_mpp=target_mpp)

    def with_tasks(self, tasks: int | None) -> Options:
        return replace(self, tasks=tasks)

    def with_min_tissue_fraction(self, least: float) -> Options:
        return replace(self, min_tissue_fraction=least)

    def with_stain_normalization(self, target: tuple[float, ...]) -> Options:
        """target: means and deviations of Lab, such as raster.stain_stats gives of an image."""
        return replace(self, stain_target=tuple(target))

    def with_grid_geometry(self, tile_px: int, tile_um: float, stride_um: float | None = None) -> Options:
        return replace(self, tile_px=tile_px, tile_um=tile_um, stride_um=stride_um)

    def with_jpeg_quality(self, quality: int) -> Options:
        """Held within 1 to 100."""
        return replace(self, jpeg_quality=min(max(quality, 1), 100))

    def with_chroma_subsampling(self, factors: str) -> Options:
        return replace(self, chroma_subsampling=factors)

    def with_observer(self, observer) -> Options:
        """One more observer, told after those already there."""
        return replace(self, observers=(*self.observers, observer))

    def with_logging(self) -> Options:
        from tessella.observers import Logging

        return self.with_observer(Logging())

    def with_progress_bar(self) -> Options:
        from tessella.observers import ProgressBar

        return self.with_observer(ProgressBar())


@dataclass(frozen=True)
class Outputs:
    """Where one slide's tiles go; each may be left out."""

    tile_dir: str | None = None
    tfrecord_file: str | None = None
    report_path: str | None = None

    def with_tile_dir(self, folder: str) -> Outputs:
        return replace(self, tile_dir=folder)

    def with_tfrecord_file(self, path: str) -> Outputs:
        return replace(self, tfrecord_file=path)

    def with_report_path(self, path: str) -> Outputs:
        return replace(self, report_path=path)

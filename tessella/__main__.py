"""Command line: python -m tessella extract SLIDE | dataset FOLDER ROOT."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tessella import api
from tessella.errors import SlideError
from tessella.options import Options, Outputs


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    where = shared.add_mutually_exclusive_group(required=True)
    where.add_argument("--level", type=int, help="a level of the pyramid, its tiles as they are")
    where.add_argument("--target-mpp", type=float, help="microns per pixel; tiles of the closest level are resampled")
    how = shared.add_mutually_exclusive_group()
    how.add_argument("--threads", type=int, help="at most so many tasks at once")
    how.add_argument("--sequential", action="store_true", help="one task")
    shared.add_argument("--min-tissue-fraction", type=float)
    shared.add_argument("--stain-normalize", metavar="JPEG", help="normalise stains to those of this image")
    shared.add_argument("--jpeg-quality", type=int, default=75)
    shared.add_argument("--chroma-subsampling", default="4:2:0", choices=["4:4:4", "4:2:2", "4:2:0"])
    shared.add_argument("--report", help="a PDF report")
    shared.add_argument("-q", "--quiet", action="store_true", help="no progress bar")
    out = argparse.ArgumentParser(prog="tessella")
    kinds = out.add_subparsers(dest="kind", required=True)
    one = kinds.add_parser("extract", parents=[shared], help="tiles of one slide")
    one.add_argument("slide")
    one.add_argument("--tfrecord-file", help="by default the slide's name, .tfrecord, in this folder")
    one.add_argument("--tile-dir")
    many = kinds.add_parser("dataset", parents=[shared], help="tiles of all slides of a folder")
    many.add_argument("folder")
    many.add_argument("root")
    many.add_argument("--tiles", action="store_true", help="write JPEG files too")
    many.add_argument("--tile-subdir")
    return out


def options_of(args: argparse.Namespace) -> Options:
    tasks = 1 if args.sequential else args.threads
    target = api.stain_target(args.stain_normalize) if args.stain_normalize else None
    o = Options(args.level, args.target_mpp, args.min_tissue_fraction, target, jpeg_quality=args.jpeg_quality, chroma_subsampling=args.chroma_subsampling, tasks=tasks)
    return o if args.quiet else o.with_progress_bar()


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        options = options_of(args)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tessella").getOrCreate()
        if args.kind == "extract":
            outputs = Outputs(args.tile_dir, args.tfrecord_file or f"{Path(args.slide).stem or 'slide'}.tfrecord", args.report)
            kept, total = api.extract(spark, args.slide, outputs, options)
            print(f"{kept} of {total} tiles kept.")
            return 0
        if args.tile_subdir and not args.tiles:
            print("--tile-subdir does nothing without --tiles", file=sys.stderr)
        done = api.extract_dataset(spark, args.folder, args.root, options, args.tiles, True, args.tile_subdir, args.report)
        print(f"{done.succeeded} of {done.total_slides} slides succeeded, {done.kept} tiles kept, {done.dropped} dropped.")
        return 0
    except (SlideError, OSError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

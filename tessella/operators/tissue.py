"""Tissue detection: histograms, Otsu's threshold, tissue fractions and the two filter stages.

A slide's histogram has at most 256 rows, so every window and join below works on small, pre-aggregated groups; pixels
are aggregated before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry


def histogram(pixels: DataFrame, keys: list[str], intensity: str = "intensity") -> DataFrame:
    return pixels.groupBy(*keys, F.col(intensity).alias("intensity")).agg(F.count(F.lit(1)).alias("n"))


def otsu(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of each key's histogram (rows intensity, n): the smallest intensity of the greatest variance between classes, 0 for a uniform or empty one."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy("intensity").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("intensity").cast("bigint") * F.col("n")
    sums = hist.select(*keys, "intensity", F.sum("n").over(upto).alias("wb"), F.sum(mass).over(upto).alias("sb"), F.sum("n").over(w).alias("total"), F.sum(mass).over(w).alias("mass"))
    wf = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.nullif(F.col("wb"), F.lit(0)) - (F.col("mass") - F.col("sb")) / F.nullif(wf, F.lit(0))
    v = F.coalesce(F.col("wb").cast("double") * wf.cast("double") * gap * gap, F.lit(0.0))
    best = F.max_by(F.when(v > 0, F.col("intensity")), F.struct(v, -F.col("intensity")))
    return sums.groupBy(*keys).agg(F.coalesce(best, F.lit(0)).cast("int").alias("threshold"))


def tissue_fraction(hist: DataFrame, thresholds: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """The part of each key's pixels at or below its slide's threshold (histogram rows of keys; thresholds by on)."""
    joined = hist.join(thresholds, on)
    below = F.sum(F.when(F.col("intensity") <= F.col("threshold"), F.col("n")).otherwise(0))
    return joined.groupBy(*keys, "threshold").agg(geometry.fraction(below, F.sum("n")).alias("tissue_fraction"))


def keep(fraction: str, least: float | None):
    """At least the minimum, both in single precision; everything where there is no minimum."""
    return F.lit(True) if least is None else F.col(fraction) >= F.lit(least).cast("float")


def overview_fraction(tiles: DataFrame, overview: DataFrame, size: tuple[str, str], scale: tuple[float, float]) -> DataFrame:
    """Tissue fraction of each rectangle (slide, x, y, w, h) over overview pixels (slide, ox, oy, g, threshold).

    A range join made equal: each rectangle lists the overview pixels of its span. An empty overview gives 1.
    """
    lox, hix = geometry.span("x", "w", F.lit(scale[0]), F.col(size[0]))
    loy, hiy = geometry.span("y", "h", F.lit(scale[1]), F.col(size[1]))
    keys = ["slide", "x", "y", "w", "h"]
    spread = tiles.select(*keys, F.explode(F.sequence(lox, hix - 1)).alias("ox"), loy.alias("_lo"), hiy.alias("_hi")).select(*keys, "ox", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("oy"))
    met = spread.join(overview, ["slide", "ox", "oy"], "left")
    seen = F.count("g")
    return met.groupBy(*keys).agg(F.when(seen == 0, F.lit(1.0).cast("float")).otherwise(geometry.fraction(F.count_if(F.col("g") <= F.col("threshold")), seen)).alias("overview_fraction"))


def counts(events: DataFrame, keys: list[str], kept: str = "kept") -> DataFrame:
    """total, kept and dropped: total is always the sum of the others."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(kept)).alias("kept"), F.count_if(~F.col(kept)).alias("dropped"))

"""Aggregates of extraction reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import int_div


def unit_bin(value: Column, bins: int = 10) -> Column:
    """The bin of a value in [0, 1] (clamped), computed in single precision."""
    clamped = F.least(F.greatest(value.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))
    return F.least(F.floor((clamped.cast("double") * bins).cast("float")).cast("int"), F.lit(bins - 1))


def range_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts over equal bins between the least and the greatest value; all in the first where these are equal."""
    ends = F.broadcast(df.agg(F.min(value).cast("float").alias("lo"), F.max(value).cast("float").alias("hi")))  # one row
    v = F.col(value).cast("float")
    share = ((v - F.col("lo")).cast("float") / (F.col("hi") - F.col("lo")).cast("float")).cast("float")
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(unit_bin(share, bins))
    return df.join(ends, F.lit(True)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def systematic_sample(tiles: DataFrame, keys: list[str], order: list[str], most: int = 8) -> DataFrame:
    """Every ceil(n / most)-th row of each key in order, numbered; at most `most` of them."""
    w = Window.partitionBy(*keys)
    numbered = tiles.withColumns({"_n": F.row_number().over(w.orderBy(*order)) - 1, "_total": F.count(F.lit(1)).over(w)})
    step = F.ceil(F.col("_total") / most).cast("bigint")
    return numbered.where(F.col("_n") % step == 0).withColumn("sample", int_div(F.col("_n").cast("bigint"), step).cast("int")).drop("_n", "_total")


def pages(df: DataFrame, order: str, size: int = 4) -> DataFrame:
    """page and place for rows in order, size a page. Numbers come from counts of sorted partitions, not from one task."""
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id() % (1 << 33)})
    counted = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counted.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_i")
    return ranged.join(F.broadcast(before), "_p").withColumns({"page": int_div(at, size), "place": at % size}).drop("_p", "_i", "_before")


def rollup(events: DataFrame, slide: str, kept: str = "kept") -> DataFrame:
    """Counts for each slide and, with a null slide, for all."""
    return events.rollup(slide).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(kept)).alias("kept"), F.count_if(~F.col(kept)).alias("dropped"))

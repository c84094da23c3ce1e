"""What the operators need from a cluster beside the core's: joins of hot keys, workers that give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.cluster import shared_folder, ship, written

__all__ = ["lean", "partitions", "shared_folder", "ship", "skew_join", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(many: DataFrame, few: DataFrame, on: list[str], size: str) -> DataFrame:
    """The inner join of many with few, a row for each key whose column `size` gives the number of its rows in many.

    Keys of more than an eighth of a partition's share are no more than eight times the partitions, whatever the data:
    they are broadcast, and their rows stay where they are; the others' rows are shuffled. Both should be written tables.
    """
    total = few.agg(F.sum(size)).first()[0] or 0
    limit = max(1, total // (8 * partitions(many.sparkSession)))
    hot = F.broadcast(few.where(F.col(size) > limit))
    cold = many.join(hot.select(*on), on, "left_anti").join(few.where(F.col(size) <= limit), on)
    return many.join(hot, on).unionByName(cold)


def lean(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """each, a function of a task's batches, made to hand its memory back to the system at the end of the task.

    Workers are used again and wait beside each other between tasks; the allocators of C and Arrow would keep what they
    once held (about 200 MB a worker after shingles of 16 MB of texts) as long as the worker lives.
    """

    def run(parts: Iterator) -> Iterator:
        try:
            yield from each(parts)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return run

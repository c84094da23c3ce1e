"""Folders watched for new slides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessella.options import Options

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def new_slides(spark: SparkSession, folder: str, a_batch: int = 100) -> DataFrame:
    """A stream of the paths of a folder's .svs files, each once, at most a_batch of them at a time; contents aren't read."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.[sS][vV][sS]").option("maxFilesPerTrigger", a_batch)
    return files.load(folder).select("path")


def extract_new(spark: SparkSession, folder: str, options: Options, out: str, checkpoint: str, a_batch: int = 100) -> StreamingQuery:
    """Extracts the tiles of what is new in a folder into out/batch=n, and ends; started again, it goes on from there.

    A batch that is repeated after a failure writes over what it had written, so every tile is there once.
    """
    from tessella.plans import extraction

    def each(paths: DataFrame, n: int) -> None:
        extraction.extract(paths, options).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return new_slides(spark, folder, a_batch).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

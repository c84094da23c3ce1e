"""What Python stages need from a cluster: this package on the workers, the shared folder, written tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Serve this package to the executors, once an application, so that workers can import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    at = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella_pkg.zip")  # the driver serves it from there
    Path(at).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only on a single machine it may be unset, and is then a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df over all cores by keys, for rows of few bytes that mean much work: a given number of partitions isn't merged by their size.

    Three a core, and 32 where the cores aren't known yet: each costs a task's start, of Python in many stages.
    """
    spark = df.sparkSession
    return df.repartition(max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 32), 3 * spark.sparkContext.defaultParallelism), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

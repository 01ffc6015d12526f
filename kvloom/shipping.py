"""Makes this package importable on executors, and keeps tables between steps."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "kvloom.shipped"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application; Spark copies the file."""
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(prefix="kvloom-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as pack:
        for folder, folders, names in os.walk(root):
            folders.sort()
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    pack.write(full, os.path.join("kvloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)


def kept(frame: DataFrame) -> DataFrame:
    """``frame`` as a table in the folder that all executors share (``spark.checkpoint.dir``), so
    that two readers see the same rows in the same partitions."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:  # set here in sessions without that setting only
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="kvloom-checkpoints-"))
    path = f"{context.getCheckpointDir()}/kvloom-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

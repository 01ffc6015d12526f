"""Names the shared folder for what is kept between steps, and writes tables there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from kvloom.shipping import ship

__all__ = ["materialise", "release", "shared_folder", "ship"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; only a session without
    that setting (tests) gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kvloom-checkpoints-"))
    return context.getCheckpointDir()


ROWS_PER_FILE = 500_000


def materialise(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """``frame`` as a table in the shared folder: its lineage is cut, a lost executor costs a
    re-read, and the planner knows its size.  The folder's owner clears it.  Where the number of
    (short) ``rows`` is known, the table has as many files as they need, not one for each shuffle
    partition."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/kvloom-{uuid.uuid4().hex}"
    if rows is not None:
        frame = frame.coalesce(max(2 * spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE))
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Deletes tables of ``materialise`` after their last reader."""
    for frame in frames:
        for folder in {name.rpartition("/")[0] for name in frame.inputFiles()}:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

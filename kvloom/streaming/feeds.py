"""Structured Streaming: change batches merged into a store, observers, subscriptions, and the
latest row of each key as keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kvloom.operators.cdc import triggered
from kvloom.operators.merge import changes, lww
from kvloom.sources.tables import Store


def changes_from(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merge_into(feed: DataFrame, store: Store, checkpoint: str, observe: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch is merged by last writer wins and committed as a version.  ``observe`` gets
    the batch's changes (hash_key, _op) first.  A batch that runs again after a failure finds its
    rows there already; ties keep them, so the result is the same."""

    def run(batch: DataFrame, number: int) -> None:
        base = store.version()
        current = store.read() if base else batch.limit(0)
        if observe is not None:
            observe(changes(current, batch), number)
        store.commit(lww(current, batch), base)

    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(feed: DataFrame, old: Column, new: Column, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Changes that concern a condition on what was there (``old``) or is there now (``new``)."""
    chosen = feed.where(triggered("_op", old, new))
    return chosen.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(feed: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """The latest row of each key as streaming state (output mode update or complete).  Equal times
    are settled by the columns, so the state does not depend on arrival."""
    newest = F.max(F.struct(time, *columns)).alias("row")
    return feed.groupBy(key).agg(newest).select(key, *[F.col(f"row.{c}") for c in (time, *columns)])


def deduplicated(feed: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first of each key within a bound on lateness, which also bounds the state."""
    return feed.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(feed: DataFrame, time: str, width: str, late: str, groups: list[str]) -> DataFrame:
    """Counts and sums by event-time window, closed by a watermark."""
    return feed.withWatermark(time, late).groupBy(F.window(time, width), *groups).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

"""Change data capture: table differences with cursors, watermarks, feeds and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.functions.scalar import has_bits, json_object
from kvloom.shipping import kept


def changed(columns: list[str], old: str = "old", new: str = "new") -> Column:
    """Whether any tracked column differs, null-safe."""
    test = F.lit(False)
    for c in columns:
        test = test | ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return test


def tracker(before: DataFrame, after: DataFrame, keys: list[str], tracked: list[str], extend: list[str] = ()) -> DataFrame:
    """keys, _op and extend_field of every inserted, deleted or (in a tracked column) updated row.
    Deleted rows extend by what they had."""
    fold = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys], F.lit(1).alias("__here")).alias(name))
    both = fold(before, "old").join(fold(after, "new"), keys, "full")
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(changed(tracked), "UPDATE")
    values = {c: F.col(c) if c in keys else F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in extend}
    out = both.withColumn("_op", op).where("_op is not null")
    return out.select(*keys, "_op", *([json_object(**values).alias("extend_field")] if extend else []))


def running_sum(rows: DataFrame, value: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``__sum``, the sum of ``value`` up to and with each row in the given order.
    Sums within range partitions, plus the sums of those before, so the rows are never gathered."""
    dealt = kept(rows.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part").agg(F.sum("__value").alias("__n"))  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn("__sum", F.sum("__value").over(inside)).join(F.broadcast(starts), "__part").withColumn("__sum", F.col("__sum") + F.col("__start")).drop("__part", "__start", "__value")


def with_cursor(rows: DataFrame, last: int, order: list[str]) -> DataFrame:
    """Cursors ``last + 1, …`` in the given order."""
    return running_sum(rows, F.lit(1).cast("long"), order).withColumn("cursor", F.lit(last) + F.col("__sum")).drop("__sum")


def clean(log: DataFrame, cursor: int) -> DataFrame:
    """Log rows that were not yet read."""
    return log.where(F.col("cursor") > cursor)


def flag_known(log: DataFrame, cursor: int, bit: int) -> DataFrame:
    """Marks rows up to a cursor as processed by one consumer."""
    return log.withColumn("flag", F.when(F.col("cursor") <= cursor, F.col("flag").bitwiseOR(F.lit(bit))).otherwise(F.col("flag")))


def incremental(rows: DataFrame, begin, end, *, time: str = "timestamp", kind: str = "all") -> DataFrame:
    """Rows written in [begin, end), in time order: all, live ones, or tombstones."""
    found = rows.where((F.col(time) >= begin) & (F.col(time) < end))
    if kind != "all":
        gone = has_bits(F.col("flag"), 0x1)
        found = found.where(gone if kind == "deleted" else ~gone)
    return found.orderBy(time)


def after_limit(limited: DataFrame, begin, end, time: str = "timestamp") -> DataFrame:
    """The time range is applied to the limited rows, not below the limit."""
    return limited.where((F.col(time) >= begin) & (F.col(time) < end)).orderBy(time)


def packets(rows: DataFrame, size: Column, most: int, order: list[str], groups: list[str] = ()) -> DataFrame:
    """Packet numbers: rows in order, a new packet each time ``most`` bytes are full.  With
    ``groups`` (a stream each) the running sum is taken in each."""
    if not groups:
        return running_sum(rows, size, order).withColumn("packet", F.floor((F.col("__sum") - size) / most).cast("long")).drop("__sum")
    running = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("packet", F.floor((F.sum(size).over(running) - size) / most).cast("long"))


def next_watermark(rows: DataFrame, keys: list[str], time: str = "timestamp") -> DataFrame:
    """The mark after a batch: one tick past the last row of each (device, user, query)."""
    return rows.groupBy(*keys).agg((F.max(time) + 1).alias("watermark"))


def merge_watermarks(marks: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Marks never go back."""
    return marks.unionByName(fresh).groupBy(*keys).agg(F.max("watermark").alias("watermark"))


def recent_queries(marks: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The query marks used last; older ones are dropped."""
    order = Window.partitionBy(*keys).orderBy(F.desc("last_query_time"), "query_id")
    return marks.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def coalesced(events: DataFrame, key: str, order: str) -> DataFrame:
    """Unread events of one key become one, the last."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), order).alias("__row")).select("__row.*")


def triggered(op: str, old: Column, new: Column) -> Column:
    """Whether a change concerns a subscription: inserts by what is new, deletes by what was there,
    updates by either."""
    old, new = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
    return F.when(F.col(op) == "INSERT", new).when(F.col(op) == "DELETE", old).otherwise(old | new)


def progress(rows: DataFrame, op: str = "_op", ok: str = "ok") -> DataFrame:
    """Counters of one sync: total, succeeded, failed, and by operation."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"),
        *[F.count_if(F.col(ok) & (F.col(op) == name)).alias(name.lower()) for name in ("INSERT", "UPDATE", "DELETE")],
    )


def touched_tables(changes: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """Tables with changes in a batch and how many."""
    counts = [(name, df.count()) for name, df in sorted(changes.items())]
    return [(name, n) for name, n in counts if n]

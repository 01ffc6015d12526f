"""The key-value store as DataFrames: physical rows, visibility, scans, writes and the cursor.

A physical row has key, value, timestamp, flag, device, ori_device, hash_key, w_timestamp,
modify_time and create_time; hash_key identifies it, and a deleted row keeps it while its key goes.
The flag bits that reads test are also kept as boolean columns, which Parquet can prune by.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from kvloom.errors import LimitError, NotFound
from kvloom.functions.scalar import glob, has_bits, hash_key
from kvloom.operators.merge import lww
from kvloom.plans import compiler
from kvloom.plans.query import MAX_KEY, Query, validate

#: Flag bits (fixed values of the row format).
DELETE, LOCAL, FORCE_PUSH_IGNORE, LOGIC_DELETE = 0x1, 0x2, 0x4, 0x8
WAIT_COMPENSATED, INCONSISTENT, KV_FORCE_PUSH_IGNORE, KV_LOGIC_DELETE = 0x10, 0x20, 0x40, 0x80
CLOUD_WRITE, SYSTEM_RECORD, UPLOAD_FINISHED, LOGOUT_DELETE = 0x100, 0x200, 0x400, 0x800
ASSET_DOWNLOADING, LOGIN_USER, CLOUD_UPDATE_LOCAL = 0x1000, 0x2000, 0x4000
KNOWLEDGE_ONE, KNOWLEDGE_TWO, ARCHIVED = 0x8000, 0x10000, 0x20000

MAX_BATCH = 128
MAX_VALUE = 4 << 20
PHYSICAL = "key binary, value binary, timestamp long, flag long, device string, ori_device string, hash_key binary, w_timestamp long, modify_time long, create_time long"


def with_flags(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"is_deleted": has_bits(F.col("flag"), DELETE), "is_local": has_bits(F.col("flag"), LOCAL), "is_system": has_bits(F.col("flag"), SYSTEM_RECORD)})


def visible(rows: DataFrame) -> DataFrame:
    """Rows that queries see: neither deleted nor system records."""
    if "is_deleted" in rows.columns:
        return rows.where("not is_deleted and not is_system")
    return rows.where(~has_bits(F.col("flag"), DELETE | SYSTEM_RECORD))


def entries(rows: DataFrame) -> DataFrame:
    return rows.select("key", "value")


def get(rows: DataFrame, key: bytes) -> DataFrame:
    """The value under a key (a deleted row has no key, so only system records are tested)."""
    return rows.where((F.col("key") == F.lit(bytearray(key))) & ~has_bits(F.col("flag"), SYSTEM_RECORD)).select("value", "w_timestamp").limit(1)


def scan_prefix(rows: DataFrame, prefix: bytes) -> DataFrame:
    """Entries whose key starts with ``prefix``, in key order."""
    return entries(visible(rows).where(compiler.starts_with(F.col("key"), prefix))).orderBy("key")


def keys(rows: DataFrame, prefix: bytes) -> DataFrame:
    return scan_prefix(rows, prefix).select("key")


def scan(rows: DataFrame, query: Query, schema=None) -> DataFrame:
    """Entries that a query selects.  With a schema, values are parsed once for all fields."""
    validate(query, has_schema=schema is not None)
    live = visible(rows)
    resolve = None
    if schema is not None:
        live = live.withColumn("__document", schema.parsed(F.col("value")))
        resolve = schema.resolver(F.col("__document"))
    if query.device is not None:
        live = live.where(compiler.starts_with(F.col("key"), query.device.encode()))
    found = compiler.where(live, query, resolve or compiler.columns_of(live), F.col("key"))
    return entries(compiler.ordered(found, query, resolve or compiler.columns_of(live)))


def count(rows: DataFrame, query: Query, schema=None) -> DataFrame:
    validate(query, has_schema=schema is not None, count=True)
    return scan(rows, query, schema).agg(F.count(F.lit(1)).alias("n"))


def count_prefix(rows: DataFrame, prefix: bytes) -> DataFrame:
    return visible(rows).where(compiler.starts_with(F.col("key"), prefix)).agg(F.count("key").alias("n"))


def scan_device(rows: DataFrame, device: str) -> DataFrame:
    """Live rows that came from ``device``; the local device is the empty text."""
    return entries(visible(rows).where(F.col("device") == device))


def scan_mode(rows: DataFrame, mode: str, low: bytes = b"", high: bytes = b"") -> DataFrame:
    """Raw collection scans: PREFIX, LESS_EQUAL, GREATER_EQUAL or RANGE, in key order."""
    key = F.col("key")
    tests = {
        "PREFIX": lambda: compiler.starts_with(key, low),
        "LESS_EQUAL": lambda: key <= F.lit(bytearray(high or low)),
        "GREATER_EQUAL": lambda: key >= F.lit(bytearray(low)),
        "RANGE": lambda: key.between(F.lit(bytearray(low)), F.lit(bytearray(high))),
    }
    return rows.where(tests[mode]()).orderBy("key")


# --- writes ------------------------------------------------------------------------------------


def stamped(batch: DataFrame, now: int, device: str = "") -> DataFrame:
    """Physical rows for new entries (key, value); a null value deletes its key."""
    gone = F.col("value").isNull()
    return batch.select(
        F.when(~gone, F.col("key")).alias("key"), "value", F.lit(now).alias("timestamp"),
        F.when(gone, LOCAL | DELETE).otherwise(LOCAL).cast("long").alias("flag"), F.lit("").alias("device"), F.lit(device).alias("ori_device"),
        hash_key(F.col("key")).alias("hash_key"), F.lit(now).alias("w_timestamp"), F.lit(now).alias("modify_time"), F.lit(now).alias("create_time"),
    )


def check_batch(batch: list[tuple[bytes, bytes | None]]) -> list[tuple[bytes, bytes | None]]:
    if not 0 < len(batch) <= MAX_BATCH:
        raise LimitError(f"a batch has 1 to {MAX_BATCH} entries")
    for key, value in batch:
        if not 0 < len(key) <= MAX_KEY or value is not None and len(value) > MAX_VALUE:
            raise LimitError("key or value is empty or too long")
    return batch


def put(rows: DataFrame, batch: DataFrame, now: int, device: str = "") -> DataFrame:
    """The store after local writes; a delete of a row that is not there writes nothing."""
    incoming = stamped(batch, now, device)
    live = rows.where(~has_bits(F.col("flag"), DELETE)).select("hash_key")
    gone = incoming.where("value is null").join(live, "hash_key", "left_semi")
    return lww(rows, incoming.where("value is not null").unionByName(gone), local=True)


def delete_present(rows: DataFrame, key: bytes) -> None:
    if rows.where((F.col("key") == F.lit(bytearray(key))) & ~has_bits(F.col("flag"), DELETE)).isEmpty():
        raise NotFound("no such key")


def put_local(local: DataFrame, batch: DataFrame) -> DataFrame:
    """The local table after upserts (key, value); a null value takes the row away for good."""
    kept = local.join(batch, "key", "left_anti")
    return kept.unionByName(batch.where("value is not null"), allowMissingColumns=True)


def publish(rows: DataFrame, local: DataFrame, key: bytes, now: int) -> tuple[DataFrame, DataFrame]:
    """Moves one entry from the local table to the store."""
    chosen = local.where(F.col("key") == F.lit(bytearray(key))).select("key", "value")
    return put(rows, chosen, now), local.where(F.col("key") != F.lit(bytearray(key)))


def unpublish(rows: DataFrame, local: DataFrame, key: bytes, now: int) -> tuple[DataFrame, DataFrame]:
    """Moves one entry back; the store keeps its tombstone."""
    chosen = visible(rows).where(F.col("key") == F.lit(bytearray(key))).select("key", "value")
    return put(rows, chosen.withColumn("value", F.lit(None).cast("binary")), now), put_local(local, chosen)


def update_key(rows: DataFrame, change) -> DataFrame:
    """Every live key rewritten by ``change`` (column to column) and hashed anew."""
    live = ~has_bits(F.col("flag"), DELETE)
    changed = F.when(live, change(F.col("key"))).otherwise(F.col("key"))
    return rows.withColumn("key", changed).withColumn("hash_key", F.when(live, F.unhex(F.sha2("key", 256))).otherwise(F.col("hash_key")))


def remove_matching(rows: DataFrame, prefixes: Iterable[str], path: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Up to ``limit`` local rows (smallest keys) whose key has one of the prefixes and matches a
    path pattern are removed: the rest, and the removed keys."""
    text = F.col("key").cast("string")
    named = F.lit(False)
    for p in prefixes:
        named = named | text.startswith(p)
    gone = rows.where(has_bits(F.col("flag"), LOCAL) & named & glob(text, path)).orderBy("key").select("key", "hash_key").limit(limit)
    return rows.join(gone.select("hash_key"), "hash_key", "left_anti").select(*rows.columns), gone.select("key")


def integrity(rows: DataFrame) -> DataFrame:
    """Faults: live rows whose hash is not their key's, and hashes held by several rows."""
    wrong = rows.where(~has_bits(F.col("flag"), DELETE) & (F.col("hash_key") != F.unhex(F.sha2("key", 256)))).select("hash_key", F.lit("hash").alias("fault"))
    twice = rows.groupBy("hash_key").count().where("count > 1").select("hash_key", F.lit("duplicate").alias("fault"))
    return wrong.unionByName(twice)


def unsynced(rows: DataFrame, begin: int, end: int) -> DataFrame:
    """Counts of local changes in [begin, end): all, and tombstones."""
    mine = rows.where((F.col("timestamp") >= begin) & (F.col("timestamp") < end) & has_bits(F.col("flag"), LOCAL))
    return mine.agg(F.count(F.lit(1)).alias("n"), F.count_if(has_bits(F.col("flag"), DELETE)).alias("n_deleted"))


def bytes_to_sync(rows: DataFrame, begin: int, overhead: int = 64) -> DataFrame:
    mine = rows.where((F.col("timestamp") >= begin) & has_bits(F.col("flag"), LOCAL))
    size = F.coalesce(F.length("key"), F.lit(0)) + F.coalesce(F.length("value"), F.lit(0)) + overhead
    return mine.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes"))


# --- keys of devices ---------------------------------------------------------------------------


def device_key(device: Column, key: Column) -> Column:
    """device, key, and the device's length in four little-endian bytes."""
    size = F.length(device.cast("binary"))
    tail = [F.unhex(F.lpad(F.hex((F.shiftright(size, 8 * i)).bitwiseAND(255)), 2, "0")) for i in range(4)]
    return F.concat(device.cast("binary"), key, *tail)


def device_of(stored: Column) -> tuple[Column, Column]:
    """The device and the key that a stored key was made of."""
    total = F.length(stored)
    size = F.lit(0)
    for i in range(4):
        byte = F.conv(F.hex(F.substr(stored, total - F.lit(3 - i), F.lit(1))), 16, 10).cast("int")
        size = size + byte * (1 << 8 * i)
    return F.substr(stored, F.lit(1), size).cast("string"), F.substr(stored, size + 1, total - size - 4)


def trimmed(key: Column) -> Column:
    """A text key without blanks at its ends; too long is empty."""
    bare = F.regexp_replace(key, r"^\s+|\s+$", "")
    return F.when(F.octet_length(bare) <= MAX_KEY, bare).otherwise("")


def envelope(value: Column) -> tuple[Column, Column, Column]:
    """Type tag, and the big-endian integer and the text that may follow it."""
    return F.conv(F.hex(F.substring(value, 1, 1)), 16, 10).cast("int"), F.conv(F.hex(F.substring(value, 2, 8)), 16, -10).cast("long"), F.substring(value, 2, 1 << 30).cast("string")


# --- cursor ------------------------------------------------------------------------------------


class Cursor:
    """Moves over a query's rows.  Positions are given by a numbered table, a page of which is
    fetched at a time, so the driver never holds more than ``page`` rows."""

    def __init__(self, rows: DataFrame, order: list[str], page: int = 1000):
        spread = rows.sparkSession.sparkContext.defaultParallelism
        dealt = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order)
        part = dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        part = part.withColumn("__at", F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)).persist()
        sizes = {r["__part"]: r["count"] for r in part.groupBy("__part").count().collect()}
        starts, total = {}, 0
        for p in sorted(sizes):
            starts[p] = total
            total += sizes[p]
        offsets = F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(v))]) if starts else F.lit(None)
        self._rows = part.withColumn("__n", F.col("__at") + (offsets[F.col("__part")] if starts else F.lit(0))).drop("__part", "__at")
        self.count, self.page, self.position = total, page, -1
        self._window: tuple[int, list[Row]] = (0, [])

    def move_to(self, position: int) -> bool:
        """Goes to a position; outside the rows it stops before the first or after the last."""
        self.position = max(-1, min(position, self.count))
        return 0 <= position < self.count

    def move(self, steps: int) -> bool:
        return self.move_to(self.position + steps)

    def next(self) -> bool:
        return self.move(1)

    def previous(self) -> bool:
        return self.move(-1)

    def first(self) -> bool:
        return self.move_to(0)

    def last(self) -> bool:
        return self.move_to(self.count - 1)

    def is_first(self) -> bool:
        return self.count > 0 and self.position == 0

    def is_last(self) -> bool:
        return self.count > 0 and self.position == self.count - 1

    def is_before_first(self) -> bool:
        return self.count == 0 or self.position < 0

    def is_after_last(self) -> bool:
        return self.count == 0 or self.position >= self.count

    def entry(self) -> Row:
        if not 0 <= self.position < self.count:
            raise NotFound("the cursor is not on a row")
        start, rows = self._window
        if not start <= self.position < start + len(rows):
            start = self.position - self.position % self.page
            rows = self._rows.where(F.col("__n").between(start, start + self.page - 1)).orderBy("__n").drop("__n").collect()
            self._window = start, rows
        return rows[self.position - start]

    def __iter__(self) -> Iterator[Row]:
        while self.next():
            yield self.entry()

    def close(self) -> None:
        self._rows.unpersist()


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Positions from 0 within one small result."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)

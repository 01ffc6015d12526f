"""The registered queries of the engine and their SQL twins.

The supplied tables stand in for stores: customers are key-value rows (the name is the key), orders
exist in two versions, events carry JSON values, conversations are documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.functions import scalar
from kvloom.functions.json_schema import Schema
from kvloom.operators import assets, cdc, cloud, commits, documents, joins, merge, store, text
from kvloom.plans import compiler, sqlgate
from kvloom.plans.query import Query
from kvloom.sources.tables import register, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- predicates, order, counts -----------------------------------------------------------------

_EVENT = "event_id, user_id, event_type, value"


def _events(spark, sf_dir, q: Query) -> DataFrame:
    return compiler.run(table(spark, sf_dir, "events"), q).select(*_EVENT.split(", "))


@query(f"SELECT {_EVENT} FROM events WHERE event_type = 'click' AND value > 10")
def eq_filter(spark, sf_dir):
    return _events(spark, sf_dir, Query().equal_to("event_type", "click").and_().greater_than("value", 10))


@query(f"SELECT {_EVENT} FROM events WHERE event_type <> 'view'")
def neq_filter(spark, sf_dir):
    return _events(spark, sf_dir, Query().not_equal_to("$.event_type", "view"))


@query(f"SELECT {_EVENT} FROM events WHERE value >= 50 AND value <= 100 AND user_id < 100 AND event_id > 10")
def range_cmp(spark, sf_dir):
    return _events(spark, sf_dir, Query().between("value", 50.0, 100.0).and_().less_than("user_id", 100).and_().greater_than("event_id", 10))


@query(f"SELECT {_EVENT} FROM events WHERE user_id IN (1, 5, 8, 13, 21)")
def in_filter(spark, sf_dir):
    return _events(spark, sf_dir, Query().in_("user_id", [1, 5, 8, 13, 21]))


@query(f"SELECT {_EVENT} FROM events WHERE event_type NOT IN ('click', 'error')")
def not_in_filter(spark, sf_dir):
    return _events(spark, sf_dir, Query().not_in("event_type", ["click", "error"]))


@query("SELECT event_id, CAST(value IS NULL AS BOOLEAN) AS no_value FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events) WHERE value IS NULL OR event_id < 50")
def null_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    found = compiler.run(rows, Query().is_null("value").or_().less_than("event_id", 50))
    return found.select("event_id", F.col("value").isNull().alias("no_value"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%build%'")
def like_ci(spark, sf_dir):
    return compiler.run(table(spark, sf_dir, "customer"), Query().like("c_mktsegment", "%BuiLd%")).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT ILIKE 'small%'")
def not_like_ci(spark, sf_dir):
    return compiler.run(table(spark, sf_dir, "part"), Query().not_like("p_name", "SMALL%")).select("p_partkey", "p_name")


@query(f"SELECT {_EVENT} FROM events WHERE (event_type = 'click' OR event_type = 'purchase') AND value > 100 OR user_id = 8")
def grouped_or_and(spark, sf_dir):
    q = Query().begin_group().equal_to("event_type", "click").or_().equal_to("event_type", "purchase").end_group().and_().greater_than("value", 100).or_().equal_to("user_id", 8)
    return _events(spark, sf_dir, q)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def order_limit_offset(spark, sf_dir):
    return compiler.run(table(spark, sf_dir, "orders"), Query().order_by("o_totalprice", False).order_by("o_orderkey").limit(20, 5)).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events) ORDER BY value ASC NULLS FIRST, event_id DESC LIMIT 2500")
def order_multi_desc_nulls(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return compiler.run(rows, Query().order_by("value").order_by("event_id", False).limit(2500))


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def count_query(spark, sf_dir):
    return compiler.count(table(spark, sf_dir, "orders"), Query().equal_to("o_orderpriority", "1-URGENT").and_().greater_than("o_totalprice", 100000))


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def min_max_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 2) UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000")
def multi_table_query(spark, sf_dir):
    q = Query().from_("customer").in_("c_nationkey", [1, 2]).from_("supplier").greater_than("s_acctbal", 5000)
    parts = {name: compiler.run(table(spark, sf_dir, name), one) for name, one in q.by_table().items()}
    return parts["customer"].select("c_custkey", "c_nationkey").union(parts["supplier"].select("s_suppkey", "s_nationkey"))


@query(f"SELECT {_EVENT} FROM events WHERE event_type = 'view' AND user_id >= 100 ORDER BY event_id LIMIT 100")
def predicate_adapter(spark, sf_dir):
    steps = [("equalTo", "event_type", "view"), ("and",), ("greaterThanOrEqualTo", "user_id", 100), ("orderByAsc", "event_id"), ("limit", 100, 0)]
    return _events(spark, sf_dir, Query.from_json(compiler.from_predicates(steps).to_json()))


# --- key-value store ---------------------------------------------------------------------------

_FLAG = "CASE WHEN c_custkey % 10 = 0 THEN 1 WHEN c_custkey % 97 = 0 THEN 512 WHEN c_custkey % 2 = 1 THEN 2 ELSE 0 END"
_KV = f"(SELECT c_custkey, c_name AS key, c_mktsegment AS value, c_acctbal, {_FLAG} AS flag, c_custkey * 1000 AS timestamp, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'd1' ELSE 'd2' END AS device FROM customer)"
_LIVE = f"(SELECT * FROM {_KV} WHERE flag NOT IN (1, 512))"


def _kv(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    key = F.col("c_name").cast("binary")
    flag = F.when(c % 10 == 0, store.DELETE).when(c % 97 == 0, store.SYSTEM_RECORD).when(c % 2 == 1, store.LOCAL).otherwise(0)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", key.alias("key"), F.col("c_mktsegment").cast("binary").alias("value"), (c * 1000).alias("timestamp"), flag.cast("long").alias("flag"),
        F.when(c % 3 == 0, "").when(c % 3 == 1, "d1").otherwise("d2").alias("device"), F.lit("").alias("ori_device"), scalar.hash_key(key).alias("hash_key"),
        (c * 1000).alias("w_timestamp"), (c * 1000).alias("modify_time"), (c * 1000).alias("create_time"), "c_acctbal",
    )


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"SELECT value FROM {_KV} WHERE key = 'Customer#000000021' AND flag <> 512")
def kv_get(spark, sf_dir):
    return store.get(_kv(spark, sf_dir), b"Customer#000000021").select(F.col("value").cast("string").alias("value"))


@query(f"SELECT key, value FROM {_LIVE} WHERE starts_with(key, 'Customer#0000000')")
def kv_prefix_scan(spark, sf_dir):
    return _shown(store.scan_prefix(_kv(spark, sf_dir), b"Customer#0000000"))


@query(f"SELECT key FROM {_LIVE} WHERE starts_with(key, 'Customer#00000001')")
def kv_keys(spark, sf_dir):
    return store.keys(_kv(spark, sf_dir), b"Customer#00000001").select(F.col("key").cast("string").alias("key"))


@query(f"SELECT key, value FROM {_LIVE} WHERE starts_with(key, 'Customer#') AND (value = 'BUILDING' OR value = 'MACHINERY')")
def prefix_and_predicate(spark, sf_dir):
    rows = store.visible(_kv(spark, sf_dir)).withColumn("segment", F.col("value").cast("string"))
    q = Query().prefix_key("Customer#").equal_to("segment", "BUILDING").or_().equal_to("segment", "MACHINERY")
    return _shown(compiler.run(rows, q, key=F.col("key")))


@query(f"SELECT key, value FROM {_LIVE} WHERE key IN ('Customer#000000001', 'Customer#000000010', 'Customer#000000097', 'Customer#000000123')")
def in_keys(spark, sf_dir):
    return _shown(store.scan(_kv(spark, sf_dir), Query().in_keys([f"Customer#{i:09d}" for i in (1, 10, 97, 123)])))


@query(f"SELECT key, value FROM {_LIVE} WHERE key BETWEEN 'Customer#000000050' AND 'Customer#000000120'")
def key_range(spark, sf_dir):
    return _shown(store.scan(_kv(spark, sf_dir), Query().range("Customer#000000050", "Customer#000000120")))


@query(f"SELECT key, value FROM {_LIVE} WHERE key <= 'Customer#000000030'")
def raw_scan_mode(spark, sf_dir):
    return _shown(store.scan_mode(store.visible(_kv(spark, sf_dir)), "LESS_EQUAL", high=b"Customer#000000030"))


@query(f"SELECT key, value FROM {_LIVE} WHERE device = 'd2'")
def device_scan(spark, sf_dir):
    return _shown(store.scan_device(_kv(spark, sf_dir), "d2"))


@query(f"SELECT count(*) AS n FROM {_LIVE} WHERE starts_with(key, 'Customer#0000001')")
def kv_count_prefix(spark, sf_dir):
    return store.count_prefix(_kv(spark, sf_dir), b"Customer#0000001")


@query(f"SELECT key FROM {_LIVE} ORDER BY timestamp DESC LIMIT 15")
def write_time_order(spark, sf_dir):
    return store.scan(_kv(spark, sf_dir), Query().prefix_key("Customer").order_by_write_time(False).limit(15)).select(F.col("key").cast("string").alias("key"))


@query(f"SELECT count(*) AS n, count(*) FILTER (flag = 1) AS n_deleted FROM {_KV} WHERE timestamp >= 5000 AND timestamp < 90000 AND flag = 2")
def unsynced_count(spark, sf_dir):
    return store.unsynced(_kv(spark, sf_dir), 5000, 90000)


@query(f"SELECT CAST(sum(octet_length(encode(key)) + octet_length(encode(value)) + 64) AS BIGINT) AS n_bytes FROM {_KV} WHERE timestamp >= 1000 AND flag = 2")
def bytes_to_sync(spark, sf_dir):
    return store.bytes_to_sync(_kv(spark, sf_dir), 1000)


@query(
    f"""SELECT key, value, w FROM (
    SELECT k.c_custkey, k.key, CASE WHEN k.c_custkey % 4 = 0 THEN 'new' ELSE k.value END AS value, CASE WHEN k.c_custkey % 4 = 0 THEN greatest(k.timestamp + 1, 500000) ELSE k.timestamp END AS w,
      CASE WHEN k.c_custkey % 4 = 0 THEN 2 ELSE flag END AS flag FROM {_KV} k) WHERE flag <> 1"""
)
def kv_put(spark, sf_dir):
    rows = _kv(spark, sf_dir)
    batch = rows.where("c_custkey % 4 = 0").select("key", F.lit(bytearray(b"new")).alias("value"))
    done = store.put(rows.drop("c_custkey", "c_acctbal"), batch, 500_000)
    return done.where(~scalar.has_bits(F.col("flag"), store.DELETE)).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("w_timestamp").alias("w"))


@query(f"SELECT hash, flag FROM (SELECT sha256(key) AS hash, CASE WHEN c_custkey % 6 = 0 AND flag <> 1 THEN 3 ELSE flag END::BIGINT AS flag FROM {_KV}) WHERE flag % 2 = 1")
def tombstone_visibility(spark, sf_dir):
    rows = _kv(spark, sf_dir)
    batch = rows.where("c_custkey % 6 = 0").select("key", F.lit(None).cast("binary").alias("value"))
    done = store.put(rows.drop("c_custkey", "c_acctbal"), batch, 10**9)
    return done.where(scalar.has_bits(F.col("flag"), store.DELETE)).select(F.lower(F.hex("hash_key")).alias("hash"), "flag")


@query(f"SELECT 'x' || key AS key, sha256('x' || key) AS hash FROM {_KV} WHERE flag <> 1")
def update_key(spark, sf_dir):
    done = store.update_key(_kv(spark, sf_dir), lambda k: F.concat(F.lit("x").cast("binary"), k))
    return done.where(~scalar.has_bits(F.col("flag"), store.DELETE)).select(F.col("key").cast("string").alias("key"), F.lower(F.hex("hash_key")).alias("hash"))


@query(f"SELECT key FROM {_KV} WHERE flag = 2 AND key GLOB 'Customer#00000*1' ORDER BY key LIMIT 25")
def remove_matching(spark, sf_dir):
    return store.remove_matching(_kv(spark, sf_dir), ["Customer#", "Other#"], "Customer#00000*1", 25)[1].select(F.col("key").cast("string").alias("key"))


@query("SELECT s_suppkey, 'dev-' || s_nationkey AS device, s_name AS key, CAST(length('dev-' || s_nationkey) + length(s_name) + 4 AS INTEGER) AS stored_length FROM supplier")
def device_key_space(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("stored", store.device_key(F.concat(F.lit("dev-"), F.col("s_nationkey").cast("string")), F.col("s_name").cast("binary")))
    device, key = store.device_of(F.col("stored"))
    return rows.select("s_suppkey", device.alias("device"), key.cast("string").alias("key"), F.length("stored").alias("stored_length"))


@query("SELECT c_custkey, trim(pad) AS key FROM (SELECT c_custkey, '  ' || c_name || ' ' AS pad FROM customer)")
def key_trim(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", store.trimmed(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("key"))


@query(f"SELECT 'hash' AS fault, count(*) AS n FROM {_KV} WHERE c_custkey % 50 = 1 AND flag & 1 = 0 UNION ALL SELECT 'duplicate', CAST(1 AS BIGINT) FROM {_KV} WHERE c_custkey % 50 = 1 HAVING count(*) > 1 UNION ALL SELECT 'twin', count(*) FROM {_KV} WHERE c_custkey % 70 = 3 AND c_custkey % 50 <> 1")
def integrity_check(spark, sf_dir):
    rows = _kv(spark, sf_dir)
    k = F.col("c_custkey")
    broken = rows.withColumn("hash_key", F.when(k % 50 == 1, scalar.hash_key(F.lit("x").cast("binary"))).otherwise(F.col("hash_key")))
    twins = broken.where((k % 70 == 3) & (k % 50 != 1))
    faults = store.integrity(broken.union(twins)).withColumn("fault", F.when((F.col("fault") == "duplicate") & (F.col("hash_key") != scalar.hash_key(F.lit("x").cast("binary"))), "twin").otherwise(F.col("fault")))
    return faults.groupBy("fault").agg(F.count("*").alias("n"))


# --- JSON values -------------------------------------------------------------------------------

EVENT_SCHEMA = json.dumps({"SCHEMA_VERSION": "1.0", "SCHEMA_MODE": "COMPATIBLE", "SCHEMA_DEFINE": {"k": "LONG, NOT NULL", "level": "INTEGER, DEFAULT 7", "tag": "STRING"}, "SCHEMA_INDEXES": ["$.k"]})


def _json_events(spark, sf_dir) -> tuple[DataFrame, Schema]:
    schema = Schema.parse(EVENT_SCHEMA)
    return table(spark, sf_dir, "events").withColumn("__document", schema.parsed(F.col("props"))), schema


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42 OR CAST(json_extract(props, '$.k') AS BIGINT) > 95")
def json_path_eq(spark, sf_dir):
    rows, schema = _json_events(spark, sf_dir)
    found = compiler.where(rows, Query().equal_to("$.k", 42).or_().greater_than("k", 95), schema.resolver(F.col("__document")))
    return found.select("event_id", schema.extract(F.col("__document"), "k")[0].alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY k DESC, event_id LIMIT 50")
def json_path_order(spark, sf_dir):
    rows, schema = _json_events(spark, sf_dir)
    named = rows.select("event_id", schema.extract(F.col("__document"), "k")[0].alias("k"))
    return compiler.run(named, Query().order_by("k", False).order_by("event_id").limit(50))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(7 AS INTEGER) AS level, CAST(0 AS INTEGER) AS n_problems FROM events")
def schema_amend(spark, sf_dir):
    rows, schema = _json_events(spark, sf_dir)
    done = rows.select("event_id", schema.amended(F.col("__document")).alias("a"), F.size(schema.problems(F.col("__document"))).alias("n_problems"))
    return done.select("event_id", "a.k", "a.level", "n_problems")


@query("SELECT event_id, '{\"user_id\":' || user_id || ',\"tag\":null}' AS body FROM events")
def json_object(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.json_object(user_id=F.col("user_id"), tag=F.lit(None).cast("string")).alias("body"))


# --- merging -----------------------------------------------------------------------------------

_OLD = "(SELECT o_orderkey AS k, o_totalprice AS v, o_orderkey * 31 % 100 AS t FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "(SELECT o_orderkey AS k, o_totalprice + 1 AS v, o_orderkey * 17 % 100 AS t FROM orders WHERE o_orderkey % 2 = 0)"


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    fields = lambda price, time: orders.select(F.col("o_orderkey").alias("hash_key"), price.alias("v"), time.alias("w_timestamp"), F.lit(0).cast("long").alias("create_time"))
    old = fields(F.col("o_totalprice"), F.col("o_orderkey") * 31 % 100).where("hash_key % 3 <> 0")
    return old, fields(F.col("o_totalprice") + 1, F.col("o_orderkey") * 17 % 100).where("hash_key % 2 = 0")


@query(f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL OR n.t > o.t THEN n.v ELSE o.v END AS v, CASE WHEN o.k IS NULL OR n.t > o.t THEN n.t ELSE o.t END AS t FROM {_OLD} o FULL JOIN {_NEW} n ON o.k = n.k")
def lww_merge(spark, sf_dir):
    return merge.lww(*_versions(spark, sf_dir)).select(F.col("hash_key").alias("k"), "v", F.col("w_timestamp").alias("t"))


@query(f"SELECT o.k, o.v FROM {_OLD} o JOIN {_NEW} n ON o.k = n.k WHERE o.t = n.t")
def lww_tie_keeps_existing(spark, sf_dir):
    pairs = merge.classify(*_versions(spark, sf_dir)).where("old.w_timestamp = new.w_timestamp and not wins")
    return pairs.select(F.col("hash_key").alias("k"), F.col("old.v").alias("v"))


@query(f"SELECT o.k, CASE WHEN o.k % 4 = 0 THEN 'NATIVE_ALL' WHEN o.k % 5 = n.k % 7 THEN 'FOREIGN_KEY_ORIG' ELSE 'FOREIGN_KEY_ONLY' END AS kind, n.t > o.t AS wins FROM {_OLD} o JOIN {_NEW} n ON o.k = n.k WHERE NOT (o.k % 11 = 0)")
def conflict_report(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    flags = lambda df, other: df.withColumns({"flag": F.when(F.col("hash_key") % 11 == 0, 1).otherwise(0) + F.when(F.lit(not other) & (F.col("hash_key") % 4 == 0), 2).otherwise(0), "ori_device": (F.col("hash_key") % (7 if other else 5)).cast("string")})
    return merge.conflicts(flags(old, False), flags(new, True)).select(F.col("hash_key").alias("k"), "kind", "wins")


@query(f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS op FROM {_NEW} n LEFT JOIN {_OLD} o ON o.k = n.k WHERE o.k IS NULL OR n.t > o.t")
def committed_changes(spark, sf_dir):
    old, new = (df.withColumn("flag", F.lit(0)) for df in _versions(spark, sf_dir))
    return merge.changes(old, new).select(F.col("hash_key").alias("k"), F.col("_op").alias("op"))


@query(f"SELECT c_custkey, CASE WHEN device = 'd1' THEN (flag | 2) & ~256 ELSE flag END::BIGINT AS flag, CASE WHEN device = 'd1' THEN '' ELSE device END AS device FROM {_KV}")
def device_data_remove(spark, sf_dir):
    return merge.remove_device(_kv(spark, sf_dir), "d1", "FLAG_ONLY").select("c_custkey", "flag", "device")


@query(f"SELECT c_custkey, device FROM {_KV} WHERE device IN ('', 'd2')")
def remove_except(spark, sf_dir):
    return merge.remove_except(_kv(spark, sf_dir), ["d2"])[0].select("c_custkey", "device")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return merge.upsert(orders, orders.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("Z")), ["o_orderkey"])


# --- incremental reads -------------------------------------------------------------------------


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def incremental_range(spark, sf_dir):
    begin, end = (F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-08"))
    return cdc.incremental(table(spark, sf_dir, "events"), begin, end, time="ts").select("event_id", "ts")


@query("SELECT o_orderkey, o_orderstatus <> 'F' AS miss_query, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def miss_query(spark, sf_dir):
    changed = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp '1997-01-01'").withColumn("value", F.col("o_totalprice"))
    return joins.missed(changed, changed.where("o_orderstatus = 'F'"), key="o_orderkey").select("o_orderkey", "miss_query", "value")


@query(f"SELECT device, max(timestamp) + 1 AS watermark FROM {_KV} GROUP BY device")
def watermark_next(spark, sf_dir):
    return cdc.next_watermark(_kv(spark, sf_dir), ["device"])


@query("SELECT user_id, event_id, CAST(floor((sum(octet_length(encode(props))) OVER (PARTITION BY user_id ORDER BY event_id) - octet_length(encode(props))) / 100) AS BIGINT) AS packet FROM events")
def sync_packets(spark, sf_dir):
    return cdc.packets(table(spark, sf_dir, "events"), F.octet_length("props"), 100, ["event_id"], ["user_id"]).select("user_id", "event_id", "packet")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def unique_queue(spark, sf_dir):
    return cdc.coalesced(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_id, value FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 200) WHERE ts >= TIMESTAMP '2024-01-10'")
def filter_after_limit(spark, sf_dir):
    top = compiler.run(table(spark, sf_dir, "events"), Query().order_by("value", False).order_by("event_id").limit(200))
    return cdc.after_limit(top, F.lit("2024-01-10").cast("timestamp"), F.lit("2100-01-01").cast("timestamp"), "ts").select("event_id", "value")


# --- cloud -------------------------------------------------------------------------------------

_SIDE = """(SELECT *, share <> cshare OR lv <> cv AS differs FROM (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS in_local, o_orderkey % 7 = 0 AS cloud_deleted, o_orderkey % 11 = 0 AS local_deleted,
  o_orderkey % 13 = 0 AS archived, CASE WHEN o_orderkey % 17 < 4 THEN o_orderkey % 17 ELSE 0 END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'g' END AS gid,
  o_orderkey % 10 * 4000000 AS lt, o_custkey % 10 * 4000000 AS ct, o_orderkey % 2 AS lw, o_custkey % 2 AS cw, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 9 = 0 THEN 16 ELSE 0 END AS flag,
  CASE WHEN o_custkey % 4 = 0 THEN 8192 ELSE 0 END AS cflag, CASE o_orderkey % 4 WHEN 0 THEN '' ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS lv, CASE o_custkey % 4 WHEN 0 THEN '' ELSE CAST(o_custkey % 4 AS VARCHAR) END AS cv,
  CASE WHEN o_orderkey % 19 = 0 THEN 's' ELSE '' END AS share, '' AS cshare, o_orderkey % 29 = 0 AS need_asset, CASE WHEN o_custkey % 8 < 4 THEN 'cloud' ELSE '' END AS device, o_orderkey % 23 = 0 AS cloud_win FROM orders))"""


def _sides(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    version = lambda x: F.when(x % 4 != 0, (x % 4).cast("string"))
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), (k % 5 != 0).alias("in_local"), (k % 7 == 0).alias("cloud_deleted"), (k % 11 == 0).alias("local_deleted"), (k % 13 == 0).alias("archived"), F.when(k % 17 < 4, k % 17).otherwise(0).alias("status"),
        F.when(k % 3 == 0, "").otherwise("g").alias("local_gid"), F.lit("g").alias("cloud_gid"), (k % 10 * 4000000).alias("local_time"), (c % 10 * 4000000).alias("cloud_time"), (k % 2).alias("local_write"), (c % 2).alias("cloud_write"),
        (F.when(k % 2 == 0, 2).otherwise(0) + F.when(k % 9 == 0, 16).otherwise(0)).alias("flag"), F.when(c % 4 == 0, 8192).otherwise(0).alias("cloud_flag"), version(k).alias("local_version"), version(c).alias("cloud_version"),
        F.when(k % 19 == 0, "s").alias("local_sharing"), F.lit("").alias("cloud_sharing"), (k % 29 == 0).alias("need_asset"), F.when(c % 8 < 4, "cloud").otherwise("").alias("device"), F.lit("").alias("origin"), (k % 23 == 0).alias("cloud_win"),
    )


def _merge_sql(newer: str, kv: bool, ignore: bool) -> str:
    kept = "((flag & 2 = 2 OR NOT local_deleted) AND device = '')" if ignore else "FALSE"
    update = f"CASE WHEN {kept} THEN 'NOT_HANDLE' ELSE 'UPDATE' END"
    return f"""CASE
  WHEN cloud_win THEN CASE WHEN cloud_deleted AND local_deleted THEN 'UPDATE_TIMESTAMP' WHEN cloud_deleted THEN 'DELETE' WHEN local_deleted THEN 'INSERT' ELSE {update} END
  WHEN status >= 2 THEN 'LOCKED_NOT_HANDLE'
  WHEN NOT in_local THEN CASE WHEN cloud_deleted THEN 'NOT_HANDLE' ELSE 'INSERT' END
  WHEN {kept} THEN 'NOT_HANDLE'
  WHEN lt > ct AND {newer} AND gid = '' THEN CASE WHEN cloud_deleted THEN 'NOT_HANDLE' WHEN local_deleted AND NOT {kv} THEN 'INSERT' ELSE 'ONLY_UPDATE_GID' END
  WHEN lt > ct AND {newer} THEN CASE WHEN cloud_deleted THEN 'CLEAR_GID' WHEN differs THEN 'ONLY_UPDATE_GID' ELSE 'NOT_HANDLE' END
  WHEN cloud_deleted THEN CASE WHEN local_deleted THEN 'UPDATE_TIMESTAMP' WHEN archived THEN 'CLEAR_GID' ELSE 'DELETE' END
  WHEN local_deleted OR archived THEN 'INSERT'
  WHEN lt = ct AND lw = cw AND (gid = '' OR share <> cshare) AND NOT need_asset THEN 'ONLY_UPDATE_GID'
  WHEN NOT need_asset AND lv <> '' AND lv = cv AND abs(lt - ct) < 10000000 AND flag & 16 = 0 AND status = 0 THEN 'NOT_HANDLE'
  WHEN {kv} AND flag & 2 = 0 AND cflag & 8192 = 0 AND lt > ct THEN 'NOT_HANDLE' ELSE {update} END"""


@query(f"SELECT k, {_merge_sql('flag & 2 = 2', False, False)} AS op, {_merge_sql('flag & 256 = 0', True, False)} AS kv_op, {_merge_sql('flag & 2 = 2', False, True)} AS own_op FROM {_SIDE}")
def cloud_merge(spark, sf_dir):
    return _sides(spark, sf_dir).select("k", cloud.merge().alias("op"), cloud.merge(kv=True).alias("kv_op"), cloud.merge(ignore=True).alias("own_op"))


@query(
    f"""SELECT k, CASE WHEN status >= 2 THEN 'LOCKED_NOT_HANDLE'
  WHEN in_local THEN CASE WHEN cloud_deleted AND NOT local_deleted THEN CASE WHEN archived THEN 'CLEAR_GID' ELSE 'DELETE' END WHEN cloud_deleted THEN 'UPDATE_TIMESTAMP' WHEN local_deleted OR archived THEN 'INSERT' ELSE 'UPDATE' END
  WHEN cloud_deleted THEN CASE WHEN gid <> '' THEN 'DELETE' ELSE 'NOT_HANDLE' END WHEN gid = '' THEN 'INSERT' ELSE 'UPDATE' END AS op FROM {_SIDE}"""
)
def force_pull(spark, sf_dir):
    return _sides(spark, sf_dir).select("k", cloud.force_pull().alias("op"))


@query(
    f"""SELECT k, CASE WHEN status >= 2 THEN 'LOCKED_NOT_HANDLE' WHEN NOT in_local OR archived THEN 'NOT_HANDLE'
  WHEN gid = '' THEN CASE WHEN cloud_deleted OR local_deleted THEN 'NOT_HANDLE' ELSE 'ONLY_UPDATE_GID' END
  WHEN cloud_deleted THEN 'CLEAR_GID' WHEN device = 'cloud' THEN CASE WHEN lt = ct THEN 'SET_CLOUD_FORCE_PUSH_FLAG_ONE' ELSE 'SET_CLOUD_FORCE_PUSH_FLAG_ZERO' END
  WHEN differs THEN 'ONLY_UPDATE_GID' ELSE 'NOT_HANDLE' END AS op FROM {_SIDE}"""
)
def force_push(spark, sf_dir):
    return _sides(spark, sf_dir).select("k", cloud.force_push().alias("op"))


@query(f"SELECT k, CASE WHEN status >= 2 THEN 'LOCKED_NOT_HANDLE' WHEN NOT in_local THEN CASE WHEN cloud_deleted THEN 'NOT_HANDLE' ELSE 'INSERT' END WHEN lt < ct THEN 'UPDATE' WHEN lt = ct THEN 'INTEGRATE' ELSE 'DELETE' END AS op FROM {_SIDE} WHERE NOT cloud_win")
def custom_strategy(spark, sf_dir):
    decide = lambda rows: rows.withColumn("decision", F.expr("CASE WHEN local_time < cloud_time THEN 'UPSERT' WHEN local_time = cloud_time THEN 'INTEGRATE' ELSE 'DELETE' END"))
    return cloud.custom(_sides(spark, sf_dir).where("NOT cloud_win"), decide, cloud.merge()).select("k", "op")


@query(f"SELECT c_custkey FROM {_KV} WHERE device = 'd1' AND c_custkey % 6 = 1")
def compensated_rows(spark, sf_dir):
    log = _kv(spark, sf_dir).withColumn("userid", F.col("device")).withColumn("flag", F.when(F.col("c_custkey") % 6 == 1, 16).otherwise(0))
    return _kv(spark, sf_dir).join(cloud.compensated(log, "d1"), "hash_key").select("c_custkey")


@query(f"SELECT c_custkey, CAST(7 AS BIGINT) AS timestamp, CAST(CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE flag END AS BIGINT) AS flag FROM {_KV}")
def reset_uploads(spark, sf_dir):
    rows = _kv(spark, sf_dir).withColumn("flag", F.when(F.col("c_custkey") % 4 == 0, 0x402).otherwise(F.col("flag")))
    return cloud.reset_uploads(rows, 7, time=True, uploads=True).select("c_custkey", F.col("timestamp").cast("long").alias("timestamp"), F.col("flag").cast("long").alias("flag"))


@query("SELECT o_orderkey, sha256(o_orderstatus) AS dup, sha256(CAST(o_orderkey AS VARCHAR)) AS prime FROM orders")
def row_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_orderkey_text", F.col("o_orderkey").cast("string"))
    columns = [{"name": "o_orderkey_text", "primary": True}, {"name": "o_orderstatus"}]
    marked = [columns[0], {**columns[1], "dup_check": True}]
    return rows.select("o_orderkey", cloud.row_key(marked, rows).alias("dup"), cloud.row_key(columns, rows).alias("prime"))


@query(f"SELECT c.c_custkey, CAST(coalesce(k.flag, -1) AS BIGINT) AS flag FROM customer c LEFT JOIN (SELECT * FROM {_KV} WHERE device = 'd1') k ON c.c_custkey = k.c_custkey")
def user_log(spark, sf_dir):
    live = table(spark, sf_dir, "customer").select("c_custkey", scalar.hash_key(F.col("c_name").cast("binary")).alias("hash_key"))
    log = _kv(spark, sf_dir).select("hash_key", "flag", F.col("device").alias("userid"))
    return cloud.with_log(live, log, "d1").select("c_custkey", F.coalesce("flag", F.lit(-1)).cast("long").alias("flag"))


_LOG = f"(SELECT c_custkey, timestamp, flag | CASE WHEN c_custkey % 4 = 1 THEN 2 ELSE 0 END | CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 0 END AS flag, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'g' END AS gid FROM {_KV})"
_UPLOAD = f"(SELECT c_custkey, CASE WHEN flag & 1 = 1 THEN 'DELETE' WHEN gid = '' THEN 'INSERT' ELSE 'UPDATE' END AS mode FROM {_LOG} WHERE timestamp > 20000 AND flag & 2 = 2 AND NOT (flag & 1 = 1 AND gid = ''))"


def _log(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    more = F.when(c % 4 == 1, 2).otherwise(0).bitwiseOR(F.when(c % 10 == 0, 2).otherwise(0)).cast("long")
    return _kv(spark, sf_dir).withColumn("flag", F.col("flag").bitwiseOR(more)).withColumn("cloud_gid", F.when(c % 3 == 0, "").otherwise("g"))


@query(f"SELECT c_custkey, mode FROM {_UPLOAD}")
def cloud_upload_classify(spark, sf_dir):
    return cloud.upload_batch(_log(spark, sf_dir), 20000).select("c_custkey", "mode")


@query(f"SELECT mode, count(*) AS n FROM {_UPLOAD} GROUP BY mode")
def mode_counts(spark, sf_dir):
    return cloud.upload_counts(_log(spark, sf_dir), 20000)


@query("SELECT o_orderkey, CAST(CASE WHEN s = 1 AND o_custkey % 2 = 0 THEN 0 ELSE s END AS INTEGER) AS status FROM (SELECT *, CAST(CASE WHEN o_orderkey % 4 = 2 THEN 3 ELSE o_orderkey % 4 END AS INTEGER) AS s FROM orders)")
def row_lock_states(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("s", cloud.lock_after_change((F.col("o_orderkey") % 4).cast("int")))
    return rows.select("o_orderkey", cloud.lock_after_upload(F.col("s"), F.col("o_custkey") % 2, F.lit(0)).cast("int").alias("status"))


# --- change capture ----------------------------------------------------------------------------

_BEFORE = "(SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0)"
_AFTER = "(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)"
_DIFF = f"(SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'INSERT' WHEN a.c_custkey IS NULL THEN 'DELETE' WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN 'UPDATE' END AS op FROM {_BEFORE} b FULL JOIN {_AFTER} a ON a.c_custkey = b.c_custkey)"


def _tracked(spark, sf_dir) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    after = customer.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")))
    return cdc.tracker(customer.where("c_custkey % 5 <> 0"), after, ["c_custkey"], ["c_acctbal"]).withColumnRenamed("_op", "op")


@query(f"SELECT c_custkey, op FROM {_DIFF} WHERE op IS NOT NULL")
def tracker_diff(spark, sf_dir):
    return _tracked(spark, sf_dir)


@query(f"SELECT c_custkey, op, 100 + row_number() OVER (ORDER BY c_custkey) AS cursor FROM {_DIFF} WHERE op IS NOT NULL")
def tracker_cursor(spark, sf_dir):
    return cdc.with_cursor(_tracked(spark, sf_dir), 100, ["c_custkey"])


_KEYS = [joins.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), joins.ForeignKey("orders", "o_custkey", "customer", "c_custkey"), joins.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"), joins.ForeignKey("nation", "n_regionkey", "region", "r_regionkey"), joins.ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey")]


@query("SELECT o_orderkey, c_custkey, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000")
def fk_chain_subscribe(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")}
    tables["orders"] = tables["orders"].where("o_totalprice > 100000")
    return joins.chain(tables, _KEYS, "orders", ["customer", "region"]).select("o_orderkey", "c_custkey", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) WHERE (l_orderkey, l_linenumber) > (3000, 3) ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 500")
def keyset_page(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return joins.page(rows.where(joins.after_cursor(["l_orderkey", "l_linenumber"], [3000, 3])), ["l_orderkey", "l_linenumber", "l_partkey"], None, 500)


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 9 <> 0) AS succeeded, count(*) FILTER (event_id % 9 = 0) AS failed, count(*) FILTER (event_id % 9 <> 0 AND event_id % 3 = 0) AS insert, count(*) FILTER (event_id % 9 <> 0 AND event_id % 3 = 1) AS update, count(*) FILTER (event_id % 9 <> 0 AND event_id % 3 = 2) AS delete FROM events")
def sync_progress(spark, sf_dir):
    e = F.col("event_id")
    op = F.when(e % 3 == 0, "INSERT").when(e % 3 == 1, "UPDATE").otherwise("DELETE")
    return cdc.progress(table(spark, sf_dir, "events").select(op.alias("_op"), (e % 9 != 0).alias("ok")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN value > 50 WHEN 1 THEN user_id > 75 ELSE value > 50 OR user_id > 75 END AS fires FROM events")
def subscription_trigger(spark, sf_dir):
    e = F.col("event_id")
    op = F.when(e % 3 == 0, "INSERT").when(e % 3 == 1, "DELETE").otherwise("UPDATE")
    rows = table(spark, sf_dir, "events").withColumn("_op", op)
    return rows.select("event_id", cdc.triggered("_op", F.col("user_id") > 75, F.col("value") > 50).alias("fires"))


# --- joins -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_log(spark, sf_dir):
    return joins.with_log(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def join_left_log(spark, sf_dir):
    return joins.log_with_data(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), "c_custkey", "o_custkey").select("o_orderkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return joins.members(table(spark, sf_dir, "customer"), rich, "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti(spark, sf_dir):
    return joins.strangers(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


# --- documents ---------------------------------------------------------------------------------

_DOCS = "(SELECT conv_id || '-' || turn AS id, conv_id, turn, role, length(text) AS size FROM conversations)"


def _collection(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    meta = F.struct("turn", F.length("text").alias("size"))
    key = F.concat_ws("-", "conv_id", "turn")
    return rows.select(key.alias("_id"), F.to_json(F.struct(key.alias("_id"), "conv_id", "role", meta.alias("meta"))).alias("doc"))


@query(f"SELECT id AS _id FROM {_DOCS} WHERE role = 'assistant'")
def doc_find_eq(spark, sf_dir):
    return documents.match(_collection(spark, sf_dir), {"role": "assistant"}, arrays=False).select("_id")


@query(f"SELECT id AS _id FROM {_DOCS} WHERE turn = 1 AND role = 'assistant'")
def doc_find_nested(spark, sf_dir):
    return documents.match(_collection(spark, sf_dir), {"meta.turn": 1, "role": "assistant"}).select("_id")


@query(f"SELECT id AS _id, role, CAST(size AS VARCHAR) AS meta_size FROM {_DOCS} WHERE turn = 0")
def doc_project(spark, sf_dir):
    return documents.project_native(documents.match(_collection(spark, sf_dir), {"meta.turn": 0}, arrays=False), ["role", "meta.size"])


@query(f"SELECT id AS _id, id = (SELECT min(id) FROM {_DOCS} WHERE role = 'user') AS changed FROM {_DOCS}")
def doc_update_first(spark, sf_dir):
    done = documents.set_first(_collection(spark, sf_dir), {"role": "user"}, F.lit('{"changed":true}'), arrays=False)
    return done.select("_id", (F.col("doc") == '{"changed":true}').alias("changed"))


@query(f"SELECT id AS _id FROM {_DOCS} UNION ALL SELECT 'new'")
def doc_upsert(spark, sf_dir):
    return documents.upsert(_collection(spark, sf_dir), {"_id": "new"}, {"role": "system"})[0].select("_id")


@query(f"SELECT id AS _id FROM {_DOCS} WHERE id <> (SELECT min(id) FROM {_DOCS} WHERE role = 'assistant')")
def doc_delete_first(spark, sf_dir):
    return documents.delete_first(_collection(spark, sf_dir), {"role": "assistant"}, arrays=False).select("_id")


# --- versions ----------------------------------------------------------------------------------

_VER = "(SELECT l_orderkey AS k, l_linenumber AS version, l_partkey AS value, CASE WHEN l_quantity > 45 THEN 10 ELSE 9 END AS f FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1)"


def _snap_sql(version: int) -> str:
    return f"(SELECT k, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS n FROM {_VER} WHERE version <= {version}) WHERE n = 1 AND f = 9)"


def _version_rows(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(first)).where("n = 1")
    flag = F.when(F.col("l_quantity") > 45, commits.DELETE | commits.COMMITTED).otherwise(commits.ADD | commits.COMMITTED)
    return rows.select(F.col("l_orderkey").cast("string").cast("binary").alias("key"), F.col("l_partkey").alias("value"), flag.alias("oper_flag"), F.col("l_linenumber").alias("version"), F.col("l_linenumber").alias("timestamp"), F.lit(0).alias("ori_timestamp"), F.col("l_orderkey").alias("hash_key"))


@query(f"SELECT k, value FROM {_snap_sql(3)}")
def ver_snapshot(spark, sf_dir):
    return commits.snapshot(_version_rows(spark, sf_dir), 3).select(F.col("hash_key").alias("k"), "value")


@query(f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'INSERT' WHEN b.k IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op FROM {_snap_sql(2)} a FULL JOIN {_snap_sql(5)} b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.value <> b.value")
def ver_diff(spark, sf_dir):
    return commits.diff(_version_rows(spark, sf_dir), 2, 5).select(F.col("hash_key").alias("k"), F.col("_op").alias("op"))


@query(f"SELECT n.k FROM {_NEW} n LEFT JOIN {_OLD} o ON o.k = n.k WHERE o.k IS NULL OR o.t < n.t")
def ver_merge(spark, sf_dir):
    old, new = (df.withColumns({"timestamp": F.col("w_timestamp"), "ori_timestamp": F.lit(0), "value": F.col("v")}) for df in _versions(spark, sf_dir))
    return commits.to_merge(old, new).select(F.col("hash_key").alias("k"))


@query(f"SELECT k, version FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC) AS n FROM {_VER} WHERE version <= 4) WHERE n = 1 UNION ALL SELECT k, version FROM {_VER} WHERE version > 4")
def ver_vacuum(spark, sf_dir):
    return commits.vacuum(_version_rows(spark, sf_dir), 4).select(F.col("hash_key").alias("k"), "version")


# --- assets ------------------------------------------------------------------------------------


@query(
    """SELECT k, name, change FROM (
  SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, CASE WHEN a.k IS NULL THEN 'INSERT' WHEN b.k IS NULL THEN 'DELETE' WHEN a.hash <> b.hash THEN 'UPDATE' ELSE 'NO_CHANGE' END AS change FROM
  (SELECT l_orderkey AS k, 'a' || l_linenumber AS name, CAST(max(l_partkey) AS VARCHAR) AS hash FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL) a FULL JOIN
  (SELECT l_orderkey AS k, 'a' || l_linenumber AS name, CAST(max(l_partkey) + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS hash FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey, l_linenumber) b ON a.k = b.k AND a.name = b.name)"""
)
def asset_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    asset = lambda h: F.struct(F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("name"), h.cast("string").alias("hash"), F.lit("").alias("modifyTime"))
    changed = F.col("p") + F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(0)
    both = rows.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_list(F.when(F.col("l_linenumber") < 6, asset(F.col("p")))).alias("held"), F.collect_list(F.when(F.col("l_linenumber") > 2, asset(changed))).alias("wanted")
    )
    return assets.diff(both, "k", "held", "wanted").select("k", "name", "change")


# --- hashes, texts, SQL ------------------------------------------------------------------------


@query("SELECT c_custkey, sha256(c_name) AS hash FROM customer")
def pk_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.hash_hex(F.col("c_name")).alias("hash"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, sha256(unhex(sha256(CAST(l_orderkey AS VARCHAR))) || unhex(sha256(CAST(l_linenumber AS VARCHAR)))) AS hash FROM lineitem")
def composite_pk_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", scalar.composite_hash(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("hash"))


@query("SELECT p_partkey, sha256(upper(p_name)) AS nocase, sha256(rtrim(p_name || '  ')) AS trimmed FROM part")
def collated_hash(spark, sf_dir):
    padded = F.concat("p_name", F.lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.hash_hex(F.col("p_name"), "NOCASE").alias("nocase"), scalar.hash_hex(padded, "RTRIM").alias("trimmed"))


@query("SELECT p_partkey, CAST(regexp_full_match(p_name, '[a-z]+ (ring|widget)') AS INTEGER) AS m FROM part")
def regexp_full_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.regexp_match("[a-z]+ (ring|widget)", F.col("p_name")).alias("m"))


@query("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-2]?'")
def glob_match(spark, sf_dir):
    return table(spark, sf_dir, "part").where(scalar.glob(F.col("p_brand"), "Brand#[1-2]?")).select("p_partkey")


@query("SELECT p_partkey, CAST(coalesce(nullif(regexp_extract(p_partkey || 'abc', '^([0-9]+)', 1), ''), '0') AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM part")
def lenient_cast(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.cast_number(F.concat(F.col("p_partkey").cast("string"), F.lit("abc")), "bigint").alias("a"), scalar.cast_number(F.col("p_name"), "bigint").alias("b"))


@query("SELECT event_id, ((t2 - t1) - trip / 2) / 2 + ((t3 - t4) + trip / 2) / 2 AS off FROM (SELECT *, (t4 - t1) - (t3 - t2) AS trip FROM (SELECT event_id, CAST(event_id AS DOUBLE) AS t1, event_id + 7.0::DOUBLE AS t2, event_id + 9.0::DOUBLE AS t3, event_id + 20.0::DOUBLE AS t4 FROM events))")
def clock_offset(spark, sf_dir):
    e = F.col("event_id").cast("double")
    return table(spark, sf_dir, "events").select("event_id", scalar.time_offset(e, e + 7, e + 9, e + 20).alias("off"))


@query("SELECT token, count(*) AS n_parts, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT p_partkey, token, count(*) AS tf FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part) GROUP BY ALL) GROUP BY token")
def token_index(spark, sf_dir):
    return text.postings(table(spark, sf_dir, "part"), "p_partkey", "p_name").groupBy("token").agg(F.count("*").alias("n_parts"), F.sum("tf").alias("n"))


_POST = "SELECT conv_id, token, count(*) AS tf FROM (SELECT conv_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM conversations) GROUP BY ALL"


@query(
    f"""WITH post AS MATERIALIZED ({_POST}), freq AS (SELECT token, count(*) AS df FROM post GROUP BY token), total AS (SELECT count(DISTINCT conv_id) AS n FROM conversations)
SELECT conv_id, token, tf, df, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, token) AS rank FROM (
  SELECT p.conv_id, p.token, p.tf, d.df, round(p.tf * ln(total.n / d.df), 6) AS score FROM post p JOIN freq d ON p.token = d.token CROSS JOIN total)) WHERE rank <= 3"""
)
def tfidf_top(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    return text.keywords(docs, "conv_id", "text", 3)


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_acctbal > 100 AND c_nationkey <> 3 GROUP BY c_mktsegment")
def sql_bound_args(spark, sf_dir):
    register(spark, sf_dir, ["customer"])
    return sqlgate.execute(spark, "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_acctbal > ? AND c_nationkey <> ? GROUP BY c_mktsegment", [100, 3])


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'NATION_1' GROUP BY n_name")
def sql_remote_query(spark, sf_dir):
    register(spark, sf_dir, ["customer", "nation"])
    return sqlgate.remote_query(spark, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> :name GROUP BY n_name".replace(":name", "?"), ["NATION_1"])


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus")
def group_by_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '2001-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf_dir):
    one = lambda t, c, w="true": table(spark, sf_dir, t).where(w).select(F.col(c).alias("k"))
    return one("customer", "c_nationkey").intersect(one("supplier", "s_nationkey", "s_acctbal > 5000")).exceptAll(one("nation", "n_nationkey", "n_regionkey = 0").distinct())


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS running FROM events")
def window_running(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("nth"), F.round(F.sum("value").over(w), 2).alias("running"))


# --- more of the log, of merging and of plain Spark ------------------------------------------------


@query(f"SELECT n.k FROM {_NEW} n LEFT JOIN {_OLD} o ON o.k = n.k AND o.k % 4 = 0 WHERE o.k IS NULL AND n.k % 5 <> 0")
def ignore_policy(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    old = old.withColumn("flag", F.when(F.col("hash_key") % 4 == 0, 2).otherwise(0))
    new = new.withColumn("ori_device", F.when(F.col("hash_key") % 5 == 0, "").otherwise("d"))
    return merge.ignore_own(old, new).select(F.col("hash_key").alias("k"))


@query(f"SELECT o.k FROM {_OLD} o LEFT JOIN {_NEW} n ON o.k = n.k AND n.k % 7 = 0 WHERE n.k IS NULL")
def miss_erase(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return merge.erase_missed(old, new.withColumn("miss_query", F.col("hash_key") % 7 == 0))[0].select(F.col("hash_key").alias("k"))


@query(f"SELECT c_custkey, device FROM {_KV} WHERE device <> 'd2'")
def device_rows_delete(spark, sf_dir):
    return merge.remove_device(_kv(spark, sf_dir), "d2").select("c_custkey", "device")


@query(f"SELECT c_custkey, CASE WHEN device = 'd1' THEN 'moved' ELSE device END AS device, CAST(CASE WHEN device = 'd1' THEN flag | 4 ELSE flag END AS BIGINT) AS flag FROM {_KV}")
def log_update(spark, sf_dir):
    rows = _kv(spark, sf_dir)
    return merge.update_log(rows, rows["device"] == "d1", device=F.lit("moved"), flag=rows["flag"].bitwiseOR(F.lit(4))).select("c_custkey", "device", F.col("flag").cast("long").alias("flag"))


@query("SELECT c_custkey FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey <= 100)")
def purge_logically_deleted(spark, sf_dir):
    log = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("cursor"), F.when(F.col("c_custkey") % 3 == 0, 8).otherwise(0).alias("flag"))
    return merge.purge_deleted(log, 100).select("c_custkey")


@query("SELECT c_custkey AS cursor FROM customer WHERE c_custkey > 50")
def tracker_clean(spark, sf_dir):
    return cdc.clean(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cursor")), 50)


@query("SELECT c_custkey AS cursor, CAST(CASE WHEN c_custkey <= 60 THEN 33 ELSE 1 END AS INTEGER) AS flag FROM customer")
def knowledge_flags(spark, sf_dir):
    return cdc.flag_known(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cursor"), F.lit(1).alias("flag")), 60, 32)


@query("SELECT user_id, max(w) AS watermark FROM (SELECT user_id, event_id % 1000 AS w FROM events UNION ALL SELECT user_id, event_id % 700 FROM events WHERE event_type = 'click') GROUP BY user_id")
def watermark_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    fresh = events.where("event_type = 'click'").select("user_id", (F.col("event_id") % 700).alias("watermark"))
    return cdc.merge_watermarks(events.select("user_id", (F.col("event_id") % 1000).alias("watermark")), fresh, ["user_id"])


@query("SELECT user_id, query_id FROM (SELECT user_id, event_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 97 DESC, event_id) AS n FROM events) WHERE n <= 3")
def watermark_lru(spark, sf_dir):
    marks = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("query_id"), (F.col("event_id") % 97).alias("last_query_time"))
    return cdc.recent_queries(marks, ["user_id"], 3).select("user_id", "query_id")


@query("SELECT event_id, CAST(floor((sum(octet_length(encode(props))) OVER (ORDER BY event_id) - octet_length(encode(props))) / 4000) AS BIGINT) AS packet FROM events")
def sync_packets_one_stream(spark, sf_dir):
    return cdc.packets(table(spark, sf_dir, "events"), F.octet_length("props"), 4000, ["event_id"]).select("event_id", "packet")


@query("SELECT DISTINCT device FROM " + _KV)
def device_list(spark, sf_dir):
    return _kv(spark, sf_dir).select("device").distinct()


@query(f"SELECT max(version) AS newest, max(CASE WHEN f = 9 THEN version END) AS newest_live FROM {_VER}")
def max_versions(spark, sf_dir):
    live = F.when(~scalar.has_bits(F.col("oper_flag"), commits.DELETE), F.col("version"))
    return _version_rows(spark, sf_dir).agg(F.max("version").alias("newest"), F.max(live).alias("newest_live"))


@query("SELECT c_mktsegment, CAST(coalesce(c_nationkey, -1) AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).withColumn("c_nationkey", F.coalesce("c_nationkey", F.lit(-1)).cast("long"))


@query("SELECT event_type, count(*) AS n, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS bucket FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select("event_type", "n", F.unix_timestamp("w.start").alias("bucket"))


@query("SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS begun FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def session_windows(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", "n", F.unix_timestamp("w.start").alias("begun"))


@query("SELECT e.event_id, CAST(coalesce(min(n.n_nationkey), -1) AS BIGINT) AS low, count(n.n_nationkey) AS n FROM events e LEFT JOIN nation n ON e.value >= n.n_nationkey * 10 AND e.value < n.n_nationkey * 10 + 25 GROUP BY e.event_id")
def range_join(spark, sf_dir):
    events, nation = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    inside = (events["value"] >= nation["n_nationkey"] * 10) & (events["value"] < nation["n_nationkey"] * 10 + 25)
    return events.join(nation, inside, "left").groupBy("event_id").agg(F.coalesce(F.min("n_nationkey"), F.lit(-1)).cast("long").alias("low"), F.count("n_nationkey").alias("n"))


@query("SELECT p_name AS name FROM part WHERE p_size < 5 UNION SELECT s_name FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()


@query("SELECT p_partkey, CAST(i AS INTEGER) AS at, sha256(substr(p_name, CAST(i * 4 + 1 AS BIGINT), 4)) AS slice_hash FROM part, unnest(range(CAST(greatest(ceil(length(p_name) / 4.0), 1) AS BIGINT))) AS t(i)")
def value_slices(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash_key"), F.col("p_name").cast("binary").alias("value"))
    return commits.slices(rows, 4)[0].withColumnRenamed("hash_key", "p_partkey")


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: a checked query over events, ordered and limited."""
    q = Query().equal_to("event_type", "click").and_().greater_than("value", 10).order_by("value").limit(20)
    return compiler.run(table(spark, "/root/testdata/sf0.001", "events"), q)

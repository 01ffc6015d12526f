"""Store, merging, schemas, documents, versions, assets, feeds: small golden cases."""

import json

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from kvloom.errors import Conflict, KvError, LimitError, NotFound, NotSupported
from kvloom.functions import scalar
from kvloom.functions.json_schema import Schema
from kvloom.operators import assets, cdc, cloud, commits, documents, joins, merge, store, sync, text
from kvloom.plans import sqlgate
from kvloom.plans.query import Query
from kvloom.sources.tables import Store
from kvloom.streaming import feeds


def physical(spark, entries, **fixed):
    df = spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in entries], "key binary, value binary")
    rows = store.stamped(df, fixed.pop("now", 10), "")
    for c, v in fixed.items():
        rows = rows.withColumn(c, F.lit(v).cast(dict(rows.dtypes)[c]))
    return rows


def live(rows):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.entries(store.visible(rows)).collect()}


def test_put_delete_and_tombstone(spark):
    rows = physical(spark, [(b"a", b"1"), (b"b", b"2")])
    change = spark.createDataFrame([(bytearray(b"a"), None), (bytearray(b"c"), bytearray(b"3")), (bytearray(b"zz"), None)], "key binary, value binary")
    done = store.put(rows, change, 20)
    assert live(done) == {b"b": b"2", b"c": b"3"}
    gone = done.where("key is null").collect()
    assert len(gone) == 1 and bytes(gone[0]["hash_key"]).hex() == __import__("hashlib").sha256(b"a").hexdigest()
    assert done.count() == 3  # deleting what is not there writes nothing
    with pytest.raises(NotFound):
        store.delete_present(done, b"a")


def test_local_write_wins_over_later_row(spark):
    rows = physical(spark, [(b"a", b"old")], now=100)
    change = spark.createDataFrame([(bytearray(b"a"), bytearray(b"new"))], "key binary, value binary")
    row = store.put(rows, change, 50).first()
    assert bytes(row["value"]) == b"new" and row["w_timestamp"] == 101


def test_local_table_and_publishing(spark):
    rows, local = physical(spark, [(b"a", b"1")]), spark.createDataFrame([(bytearray(b"l"), bytearray(b"9"))], "key binary, value binary")
    rows, local = store.publish(rows, local, b"l", 30)
    assert live(rows) == {b"a": b"1", b"l": b"9"} and local.count() == 0
    rows, local = store.unpublish(rows, local, b"l", 40)
    assert live(rows) == {b"a": b"1"} and local.count() == 1
    assert store.put_local(local, spark.createDataFrame([(bytearray(b"l"), None)], "key binary, value binary")).count() == 0


def test_batch_limits():
    with pytest.raises(LimitError):
        store.check_batch([])
    with pytest.raises(LimitError):
        store.check_batch([(b"k", b"v")] * 129)
    with pytest.raises(LimitError):
        store.check_batch([(b"k" * 1025, b"v")])


def test_cursor(spark):
    cursor = store.Cursor(spark.range(57), ["id"], page=10)
    assert cursor.count == 57 and cursor.is_before_first()
    assert cursor.first() and cursor.is_first() and cursor.entry()["id"] == 0
    assert cursor.last() and cursor.is_last() and cursor.entry()["id"] == 56
    assert not cursor.next() and cursor.is_after_last()
    assert cursor.previous() and cursor.entry()["id"] == 56
    assert cursor.move_to(23) and cursor.move(-3) and cursor.entry()["id"] == 20
    cursor.move_to(-5)
    assert [r["id"] for r in cursor] == list(range(57))
    cursor.close()


def test_lww_tie_and_batch_order(spark):
    old = spark.createDataFrame([("k", 1, 5, 0)], "hash_key string, v int, w_timestamp long, create_time long")
    new = spark.createDataFrame([("k", 2, 5, 0, 0), ("n", 3, 7, 0, 1), ("n", 4, 7, 0, 0)], "hash_key string, v int, w_timestamp long, create_time long, arrival int")
    got = {r["hash_key"]: r["v"] for r in merge.lww(old, new).collect()}
    assert got == {"k": 1, "n": 4}


def test_ignore_own_and_missed(spark):
    old = physical(spark, [(b"mine", b"1")])
    new = physical(spark, [(b"mine", b"2"), (b"theirs", b"3")], ori_device="other", now=99)
    assert {bytes(r["key"]) for r in merge.ignore_own(old, new).collect()} == {b"theirs"}
    marked = new.withColumn("miss_query", F.col("key") == F.lit(bytearray(b"mine")))
    kept, fresh = merge.erase_missed(old, marked)
    assert kept.count() == 0 and fresh.count() == 1


def test_sync_both_ways(spark):
    here, there = physical(spark, [(b"a", b"1"), (b"b", b"h")], now=10), physical(spark, [(b"b", b"t"), (b"c", b"3")], now=20)
    here, there, marks = sync.sync(here, there, sync.PUSH_PULL, {}, 100)
    assert live(there) == {b"a": b"1", b"b": b"t", b"c": b"3"} and marks == {"sent": 100, "received": 100}
    assert live(here) == live(there)


SCHEMA = {"SCHEMA_VERSION": "1.0", "SCHEMA_MODE": "STRICT", "SCHEMA_DEFINE": {"a": "INTEGER, NOT NULL", "b": {"c": "STRING, NOT NULL, DEFAULT 'x,y'", "d": "DOUBLE"}, "e": [], "f": {}, "g": "BOOL"}, "SCHEMA_INDEXES": ["$.a", ["$.b.d"]]}


def test_schema_extraction_and_problems(spark):
    schema = Schema.parse(json.dumps(SCHEMA))
    assert schema.fields[("b", "c")].default == "x,y"
    rows = ['{"a":1,"g":true}', '{"a":1.5}', "{}", "oops", '{"a":1,"zz":1}', '{"a":7,"b":{"c":"q","d":3},"e":[1]}', '{"a":3000000000}', '{"a":1,"b":{"c":5}}', '{"a":1,"b":{"q":5}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").withColumn("d", schema.parsed(F.col("t")))
    got = {r["i"]: r["p"] for r in df.select("i", schema.problems(F.col("d")).alias("p")).collect()}
    assert [bool(got[i]) for i in range(9)] == [False, True, True, True, True, False, True, True, True]
    a = {r["i"]: r["x"] for r in df.select("i", schema.amended(F.col("d")).alias("x")).collect()}
    assert a[0]["b_c"] == "x,y" and a[0]["g"] == 1 and a[5]["b_d"] == 3.0 and a[3]["a"] is None
    with pytest.raises(KvError):
        schema.extract(F.col("d"), "e")


def test_schema_evolution():
    def changed(**fields):
        return Schema.parse(json.dumps({**SCHEMA, "SCHEMA_DEFINE": {**SCHEMA["SCHEMA_DEFINE"], **fields}}))

    base = changed()
    assert base.compare(changed()) == "EQUAL"
    assert base.compare(Schema.parse(json.dumps({**SCHEMA, "SCHEMA_INDEXES": []}))) == "COMPATIBLE"
    assert base.compare(changed(n="LONG")) == "COMPATIBLE_UPGRADE"
    assert base.compare(changed(n="LONG, NOT NULL, DEFAULT 3")) == "COMPATIBLE_UPGRADE"
    assert base.compare(changed(n="LONG, NOT NULL")) == "INCOMPATIBLE"
    assert base.compare(changed(a="LONG, NOT NULL")) == "INCOMPATIBLE"
    for broken in ({"a": "FOO"}, {"a": "INTEGER, DEFAULT x"}, {"a" * 65: "LONG"}, {"a": {"b": {"c": {"d": {"e": "LONG"}}}}}):
        with pytest.raises(KvError):
            Schema.parse(json.dumps({**SCHEMA, "SCHEMA_DEFINE": broken, "SCHEMA_INDEXES": []}))


DOCS = [
    {"_id": "1", "name": "doc1", "item": "journal", "personInfo": {"school": "AB", "age": 51}},
    {"_id": "2", "item": 1, "personInfo": [1, "my string", {"school": "AB", "age": 51}, True, {"school": "CD", "age": 15}, False]},
    {"_id": "4", "item": "paper", "personInfo": {"grade": 1, "school": "A", "age": 18}},
    {"_id": "5", "item": "journal", "personInfo": [{"sex": "woman", "school": "B", "age": 15}, {"school": "C", "age": 35}]},
    {"_id": "6", "item": False, "personInfo": [{"school": "B", "teacher": "mike", "age": 15}]},
    {"_id": "9", "item": None},
]


@pytest.fixture(scope="module")
def collection(spark):
    return documents.insert(spark.createDataFrame([], "_id string, doc string"), DOCS).persist()


@pytest.mark.parametrize(
    ("wanted", "ids"),
    [
        ({"item": "journal"}, ["1", "5"]), ({"personInfo.school": "AB"}, ["1", "2"]), ({"personInfo": {"school": "AB", "age": 51}}, ["1", "2"]), ({"personInfo": {"school": "AB"}}, []),
        ({"item": 1.0}, ["2"]), ({"item": False}, ["6"]), ({"item": None}, ["9"]), ({"name": None}, ["2", "4", "5", "6", "9"]), ({"personInfo.0.school": "B"}, ["5", "6"]), ({"_id": "4", "item": "paper"}, ["4"]), ({}, ["1", "2", "4", "5", "6", "9"]),
    ],
)
def test_find(collection, wanted, ids):
    assert [r["_id"] for r in documents.find(collection, wanted).collect()] == ids


def test_native_filter_agrees(collection):
    plain = collection.where("_id in ('1', '4', '9')")
    for wanted in ({"item": "journal"}, {"personInfo.age": 18}, {"item": None}, {"name": None}, {"item": True}):
        ids = lambda arrays: sorted(r["_id"] for r in documents.match(plain, wanted, arrays=arrays).collect())
        assert ids(True) == ids(False)


def test_projection(collection):
    one = lambda shape, **o: json.loads(documents.find(collection, {"_id": "1"}, shape, **o).first()["doc"])
    assert one({"item": 1, "personInfo.age": True}) == {"item": "journal", "personInfo": {"age": 51}}
    assert one({"personInfo": {"age": 0}}, show_id=True) == {"_id": "1", "name": "doc1", "item": "journal", "personInfo": {"school": "AB"}}
    with pytest.raises(KvError):
        documents.project(collection, {"a": 1, "b": 0})


def test_document_changes(collection):
    done, n = documents.update(collection, {"item": "journal"}, {"personInfo.age": 1, "extra.deep": 2})
    assert n == 1 and json.loads(done.where("_id = '1'").first()["doc"])["extra"] == {"deep": 2}
    assert json.loads(done.where("_id = '5'").first()["doc"]) == DOCS[3]
    assert documents.update(collection, {"item": "none"}, {"a": 1})[1] == 0
    with pytest.raises(NotFound):
        documents.update(collection, {"_id": "1"}, {"nope.nope": 1}, replace=True)
    assert documents.update(collection, {"_id": "5"}, {"personInfo.0.school": "Z"})[1] == 1
    with pytest.raises(Conflict):
        documents.insert(collection, [{"_id": "1"}])
    with pytest.raises(Conflict):
        documents.upsert(collection, {"_id": "1", "item": "other"}, {"a": 1})
    assert documents.upsert(collection, {"_id": "77"}, {"a": 1})[0].count() == 7
    assert documents.delete(collection, {"item": "journal"})[0].where("_id = '1'").isEmpty()
    with pytest.raises(NotFound):
        documents.delete(collection, {"item": "none"})
    for wrong in ({"1a": 1}, {"a-b": 1}, {"_id": ""}, {"_id": "x" * 901}, {"a": {"b": {"c": {"d": {}}}}}):
        with pytest.raises(KvError):
            documents.check_document(wrong)
    with pytest.raises(KvError):
        documents.collection_name("GRD_x")


def test_snapshot_after_clear(spark):
    rows = spark.createDataFrame(
        [("a", 1, 9, 1), ("b", 1, 9, 1), (None, None, 12, 2), ("b", 5, 9, 3), ("c", 6, 1, 4)], "hash_key string, value int, oper_flag int, version int"
    ).selectExpr("*", "cast(hash_key as binary) key", "version timestamp", "0 ori_timestamp")
    at = lambda v: {r["hash_key"]: r["value"] for r in commits.snapshot(rows, v).collect()}
    assert at(1) == {"a": 1, "b": 1} and at(2) == {} and at(4) == {"b": 5}


def test_commit_tree():
    tree = commits.CommitTree()
    a = tree.add(None, None, 1, 1, "x")
    b, c = tree.add(a, None, 2, 2, "x"), tree.add(a, None, 2, 2, "y")
    d = tree.add(b, c, 3, 3, "x")
    assert tree.history(d)[0] == d and len(tree.history(d)) == 4
    assert tree.base(b, c) == a and tree.latest("x") == d and tree.latest("z") is None


def test_slices(spark):
    rows = spark.createDataFrame([("k", bytearray(b"abcabcab")), ("e", bytearray(b""))], "hash_key string, value binary")
    places, pieces = commits.slices(rows, 3)
    assert places.where("hash_key = 'k'").count() == 3 and pieces.count() == 3


def test_assets(spark):
    asset = lambda n, h, t="": (n, h, t)
    df = spark.createDataFrame([(1, [asset("a", "1"), asset("b", "1"), asset("d", "1", "9")], [asset("b", "2"), asset("c", "1"), asset("d", "2", "1")])], "k int, held array<struct<name:string,hash:string,modifyTime:string>>, wanted array<struct<name:string,hash:string,modifyTime:string>>")
    got = lambda **o: {r["name"]: r["change"] for r in assets.diff(df, "k", "held", "wanted", **o).collect()}
    assert got() == {"a": "DELETE", "b": "UPDATE", "c": "INSERT", "d": "UPDATE"}
    assert got(policy="TIME_FIRST")["d"] == "NO_CHANGE"
    done = assets.settled(assets.diff(df, "k", "held", "wanted"), "k", "download").first()["assets"]
    assert [a["status"] for a in done] == [assets.DELETE, assets.DOWNLOADING, assets.DOWNLOADING, assets.DOWNLOADING]


def test_cloud_tagging(spark):
    local = spark.createDataFrame([("h1", "g1", 5), ("h2", "", 5)], "hash_key string, local_gid string, local_time long")
    far = spark.createDataFrame([("g1", "h1", 10**9), ("g2", "h2", 10**9), ("g3", "h3", 10**9)], "cloud_gid string, cloud_key string, cloud_time long")
    tagged = {r["cloud_gid"]: r["op"] for r in cloud.tag(local, far, cloud.merge()).collect()}
    assert tagged == {"g1": "UPDATE", "g2": "UPDATE", "g3": "INSERT"}


def test_cloud_merge_of_same_records(spark):
    base = {"in_local": True, "cloud_deleted": False, "local_deleted": False, "archived": False, "status": 0, "local_gid": "g", "cloud_gid": "g", "local_time": 5, "cloud_time": 6, "local_write": 5, "cloud_write": 6, "flag": 0, "cloud_flag": 0, "local_version": "v", "cloud_version": "v", "local_sharing": "", "cloud_sharing": None, "need_asset": False, "device": "d", "origin": "", "cloud_win": False}
    cases = [({}, "NOT_HANDLE"), ({"local_version": None, "cloud_version": None}, "UPDATE"), ({"need_asset": True}, "UPDATE"), ({"status": 1}, "UPDATE"), ({"status": 2}, "LOCKED_NOT_HANDLE"), ({"flag": 0x10}, "UPDATE")]
    cases += [({"local_gid": "", "cloud_time": 5, "cloud_write": 5, "cloud_version": "w"}, "ONLY_UPDATE_GID"), ({"local_gid": "", "cloud_time": 5, "cloud_version": "w"}, "UPDATE")]
    rows = [{"n": i, **base, **change} for i, (change, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "n int, " + ", ".join(f"{k} {t}" for k, t in cloud.INPUTS.items())).select("n", cloud.merge().alias("op"), cloud.merge(kv=True).alias("kv"))
    assert [r["op"] for r in got.orderBy("n").collect()] == [op for _, op in cases]


def test_foreign_keys_with_a_cycle():
    keys = [joins.ForeignKey("a", "k", "b", "k"), joins.ForeignKey("b", "k", "a", "k"), joins.ForeignKey("e", "f", "a", "k")]
    assert [s[0] for s in joins.path(keys, "e", "b")] == ["a", "b"]
    with pytest.raises(KvError):
        joins.path(keys, "e", "zz")
    assert joins.sync_order(["e", "b", "a"], keys)[-1] in ("e", "a", "b")
    assert joins.sync_order(["c", "p"], [joins.ForeignKey("c", "x", "p", "x")]) == ["p", "c"]


def test_keyset_pages_cover_everything(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, None), (1, 2), (2, 1), (2, 3)], "a int, b int")
    seen, cursor = [], None
    while rows := joins.page(df, ["a", "b"], cursor, 2).collect():
        seen += [tuple(r) for r in rows]
        cursor = list(rows[-1])
    assert seen == [(None, 1), (None, 2), (1, None), (1, 2), (2, 1), (2, 3)]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalar.regexp_match("a|ab", F.lit("ab")).alias("m"), scalar.regexp_match("a", F.lit("ab")).alias("n"), scalar.regexp_match("a", F.lit(None).cast("string")).alias("o"),
        scalar.same_entity(F.lit('{"a": 1}'), F.lit('{"a":1}')).alias("p"), scalar.same_entity(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("q"), scalar.same_entity(F.lit("1"), F.lit(None).cast("string")).alias("r"),
        scalar.cast_number(F.lit("12abc"), "bigint").alias("s"), scalar.cast_number(F.lit("abc"), "double").alias("t"), scalar.cast_number(F.lit(None).cast("string"), "bigint").alias("u"),
        scalar.json_object(a=F.lit(None).cast("int")).alias("v"), scalar.glob(F.lit("a]b"), "a[]]b").alias("w"), scalar.glob(F.lit("aXb"), "a[^x]?").alias("x"),
    ).first()
    assert tuple(row) == (1, 0, None, 1, 1, 0, 12, 0.0, None, '{"a":null}', True, True)
    clock = scalar.Clock()
    assert clock.now() < clock.now() < clock.now(-10**12)


def test_tokens(spark):
    row = spark.range(1).select(text.tokens(F.lit("Ab-cd 12, x")).alias("a"), text.tokens(F.lit("Abc"), "short_words", True).alias("b"), text.tokens(F.lit("ab"), "multi_words").alias("c")).first()
    assert tuple(row) == (["ab", "cd", "12", "x"], ["Ab", "bc"], ["ab", "ab"])
    index = text.postings(spark.createDataFrame([(1, "a b"), (2, "b c")], "k int, t string"), "k", "t")
    assert [r["k"] for r in text.search(index, "k", ["a", "b"]).collect()] == [1]


def test_sql_gate(spark):
    assert sqlgate.remote_query(spark, "select ? as x", ["7"]).first()["x"] == "7"
    for statement in ("create table t (a int)", "drop table t", "insert into t values (1)", "set a=b"):
        with pytest.raises(NotSupported):
            sqlgate.remote_query(spark, statement)
    with pytest.raises(LimitError):
        sqlgate.execute(spark, "select 1", ["x"] * 101)
    assert sqlgate.fits(spark.range(10))
    spark.range(5).createOrReplaceTempView("gate_rows")
    assert sqlgate.remote_query(spark, "with a as (select id from gate_rows) select count(*) as n from a where id in (select max(id) from gate_rows)").first()["n"] == 1
    path = f"parquet.`{SMALL}/region.parquet`"
    for statement in (f"select * from {path}", f"select 1 where exists (select * from {path})", f"with a as (select * from {path}) select * from a", "select java_method('java.lang.System', 'getProperty', 'user.home')", "select id from gate_rows where reflect('java.lang.System', 'nanoTime') > 0", "select * from range(3)"):
        with pytest.raises(NotSupported):
            sqlgate.remote_query(spark, statement)
    spark.range(300_000).createOrReplaceTempView("gate_rows")
    with pytest.raises(LimitError):
        sqlgate.remote_query(spark, "select id, id as other from gate_rows")


def test_versioned_store(spark, tmp_path):
    where = Store(spark, str(tmp_path / "s"))
    assert where.version() == 0 and where.commit(spark.range(3)) == 1 and where.commit(spark.range(5), 1) == 2
    assert where.read().count() == 5 and where.read(1).count() == 3
    with pytest.raises(Conflict):
        where.commit(spark.range(1), 1)
    work = where.transaction()
    work.apply(lambda df: df.where("id > 2"))
    work.rollback()
    work.apply(lambda df: df.where("id > 1"))
    assert work.commit() == 3 and where.read().count() == 3
    where.export(str(tmp_path / "backup"), 1)
    assert where.restore(str(tmp_path / "backup")) == 4 and where.read().count() == 3
    where.vacuum(2)
    assert where.versions() == [3, 4]
    with pytest.raises(NotFound):
        where.read(1)


def test_store_after_a_crash_and_with_two_writers(spark, tmp_path, monkeypatch):
    where, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    assert where.commit(spark.range(3)) == 1
    (tmp_path / "s" / "_commits" / "2").write_bytes(b"")  # a writer that died after its claim
    assert where.version() == 1 and where.read().count() == 3
    assert where.commit(spark.range(4), 1) == 3 and where.versions() == [1, 3]
    monkeypatch.setattr(other, "_claims", lambda: [1, 2])  # looked before the last commit
    with pytest.raises(Conflict):
        other.commit(spark.range(9))
    assert where.read().count() == 4


def test_streaming_merge(spark, tmp_path):
    incoming, seen = str(tmp_path / "in"), []
    where = Store(spark, str(tmp_path / "store"))
    physical(spark, [(b"a", b"1"), (b"b", b"2")], now=10).write.parquet(incoming)
    run = lambda: feeds.merge_into(feeds.changes_from(spark, incoming, store.PHYSICAL), where, str(tmp_path / "ck"), lambda df, n: seen.append({r["_op"] for r in df.collect()})).awaitTermination()
    run()
    physical(spark, [(b"a", b"9"), (b"c", None)], now=20).write.mode("append").parquet(incoming)
    run()
    assert live(where.read()) == {b"a": b"9", b"b": b"2"} and seen == [{"INSERT"}, {"UPDATE"}]


def test_streaming_state(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("b", 2, 3)], "k string, t int, v int").write.parquet(str(tmp_path / "in"))
    feed = feeds.changes_from(spark, str(tmp_path / "in"), "k string, t int, v int")
    feeds.latest_state(feed, "k", "t", ["v"]).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r["k"]: r["v"] for r in spark.table("latest").collect()} == {"a": 2, "b": 3}


def test_cursors_are_dense(spark):
    got = cdc.with_cursor(spark.range(101).repartition(7), 10, ["id"]).collect()
    assert sorted((r["cursor"], r["id"]) for r in got) == [(11 + i, i) for i in range(101)]


def test_device_query(spark):
    key = store.device_key(F.lit("dev"), F.lit("k").cast("binary"))
    rows = physical(spark, [(b"x", b"1")]).withColumn("key", key)
    assert store.scan(rows, Query().device_id("dev")).count() == 1

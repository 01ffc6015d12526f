"""Synchronising with a cloud table: upload kinds, merge strategies, row locks, key columns.

A strategy is a table of conditions read from the top; ``merge``, ``force_pull`` and ``force_push``
give the operation for a row with the columns of ``INPUTS``.  Empty and missing versions, shares,
devices and row ids are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions.scalar import composite_hash, has_bits

_DELETE, _LOCAL, _COMPENSATED, _CLOUD_WRITE, _LOGIN_USER = 0x1, 0x2, 0x10, 0x100, 0x2000
#: Rows whose times differ by less are the same record (one second in 100 ns ticks).
SAME_RECORD_TICKS = 10_000_000
UNLOCK, UNLOCKING, LOCK, LOCK_CHANGE = range(4)

INPUTS = {
    "in_local": "boolean", "cloud_deleted": "boolean", "local_deleted": "boolean", "archived": "boolean", "status": "long", "local_gid": "string", "cloud_gid": "string",
    "local_time": "long", "cloud_time": "long", "local_write": "long", "cloud_write": "long", "flag": "long", "cloud_flag": "long", "local_version": "string", "cloud_version": "string",
    "local_sharing": "string", "cloud_sharing": "string", "need_asset": "boolean", "device": "string", "origin": "string", "cloud_win": "boolean",
}


def upload_kind(flag: Column, gid: Column) -> Column:
    """DELETE, INSERT or UPDATE for a changed row."""
    return F.when(has_bits(flag, _DELETE), "DELETE").when(F.coalesce(gid, F.lit("")) == "", "INSERT").otherwise("UPDATE")


def upload_batch(log: DataFrame, since: int) -> DataFrame:
    """Local changes after a watermark with their kind; what was never uploaded and is gone again
    is left out."""
    kind = upload_kind(F.col("flag"), F.col("cloud_gid"))
    never = has_bits(F.col("flag"), _DELETE) & (F.coalesce("cloud_gid", F.lit("")) == "")
    return log.where((F.col("timestamp") > since) & has_bits(F.col("flag"), _LOCAL) & ~never).withColumn("mode", kind)


def upload_counts(log: DataFrame, since: int) -> DataFrame:
    return upload_batch(log, since).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def _first(*rules: tuple[Column, Column | str], last: Column | str) -> Column:
    """The value of the first rule that holds."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    chain = None
    for test, value in rules:
        test = F.coalesce(test, F.lit(False))
        chain = F.when(test, lit(value)) if chain is None else chain.when(test, lit(value))
    return chain.otherwise(lit(last))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _bits(name: str, bit: int) -> Column:
    return has_bits(F.coalesce(F.col(name), F.lit(0)), bit)


def _locked() -> Column:
    return F.col("status").isin(LOCK, LOCK_CHANGE)


def _differs() -> Column:
    """Whether the log has to take over the cloud's share or version."""
    return (_text("local_sharing") != _text("cloud_sharing")) | (_text("local_version") != _text("cloud_version"))


def _ignored(ignore: bool) -> Column:
    """Whether a row of this device is kept against the cloud's; one that was deleted by another
    is not."""
    return F.lit(ignore) & (_bits("flag", _LOCAL) | ~F.col("local_deleted")) & (_text("origin") == "") & (_text("device") == "")


def _update(ignore: bool) -> Column:
    return F.when(F.coalesce(_ignored(ignore), F.lit(False)), "NOT_HANDLE").otherwise("UPDATE")


def merge(*, kv: bool = False, ignore: bool = False) -> Column:
    """Cloud merge: the later side wins.  ``ignore`` keeps this device's rows."""
    c = F.col
    cd, ld, ar = c("cloud_deleted"), c("local_deleted"), c("archived")
    gid = _text("local_gid") != ""
    newer = (c("local_time") > c("cloud_time")) & (~_bits("flag", _CLOUD_WRITE) if kv else _bits("flag", _LOCAL))
    cloud_wins = _first((cd & ld, "UPDATE_TIMESTAMP"), (cd, "DELETE"), (ld, "INSERT"), last=_update(ignore))
    absent = _first((cd, "NOT_HANDLE"), last="INSERT")
    without_gid = _first((cd, "NOT_HANDLE"), *([] if kv else [(ld, "INSERT")]), last="ONLY_UPDATE_GID")
    with_gid = _first((cd, "CLEAR_GID"), (_differs(), "ONLY_UPDATE_GID"), last="NOT_HANDLE")
    deleted = _first((ld, "UPDATE_TIMESTAMP"), (ar, "CLEAR_GID"), last="DELETE")
    at_once = (c("local_time") == c("cloud_time")) & c("local_write").eqNullSafe(c("cloud_write"))
    only_gid = at_once & (~gid | (_text("local_sharing") != _text("cloud_sharing"))) & ~c("need_asset")
    known = (_text("local_version") != "") & (_text("local_version") == _text("cloud_version"))
    same = ~c("need_asset") & known & (F.abs(c("local_time") - c("cloud_time")) < SAME_RECORD_TICKS) & ~_bits("flag", _COMPENSATED) & (F.coalesce(c("status"), F.lit(UNLOCK)) == UNLOCK)
    theirs = F.lit(kv) & ~_bits("flag", _LOCAL) & ~_bits("cloud_flag", _LOGIN_USER) & (c("local_time") > c("cloud_time"))
    return _first(
        (c("cloud_win"), cloud_wins),
        (_locked(), "LOCKED_NOT_HANDLE"),
        (~c("in_local"), absent),
        (_ignored(ignore), "NOT_HANDLE"),
        (newer & ~gid, without_gid),
        (newer, with_gid),
        (cd, deleted),
        (ld | ar, "INSERT"),
        (only_gid, "ONLY_UPDATE_GID"),
        (same | theirs, "NOT_HANDLE"),
        last=_update(ignore),
    )


def force_pull(*, ignore: bool = False) -> Column:
    """The cloud's side always wins."""
    c = F.col
    cd, ld, ar, here = c("cloud_deleted"), c("local_deleted"), c("archived"), c("in_local")
    gid = _text("local_gid") != ""
    return _first(
        (_locked(), "LOCKED_NOT_HANDLE"),
        (here & _ignored(ignore), "NOT_HANDLE"),
        (here & cd & ~ld & ar, "CLEAR_GID"),
        (here & cd & ~ld, "DELETE"),
        (here & cd, "UPDATE_TIMESTAMP"),
        (here & (ld | ar), "INSERT"),
        (here, _update(ignore)),
        (cd & gid, "DELETE"),
        (cd, "NOT_HANDLE"),
        (~gid, "INSERT"),
        last=_update(ignore),
    )


def force_push() -> Column:
    """The local side always wins."""
    c = F.col
    gid = _text("local_gid") != ""
    return _first(
        (_locked(), "LOCKED_NOT_HANDLE"),
        (~c("in_local") | c("archived"), "NOT_HANDLE"),
        (~gid & (c("cloud_deleted") | c("local_deleted")), "NOT_HANDLE"),
        (~gid, "ONLY_UPDATE_GID"),
        (c("cloud_deleted"), "CLEAR_GID"),
        ((c("device") == "cloud") & (c("local_time") == c("cloud_time")), "SET_CLOUD_FORCE_PUSH_FLAG_ONE"),
        (c("device") == "cloud", "SET_CLOUD_FORCE_PUSH_FLAG_ZERO"),
        (_differs(), "ONLY_UPDATE_GID"),
        last="NOT_HANDLE",
    )


def custom(rows: DataFrame, handler, base: Column) -> DataFrame:
    """``base`` where a side is missing or locked; else what ``handler`` (a function from a frame to
    a ``decision`` column: UPSERT, DELETE, NOT_HANDLE or INTEGRATE) says."""
    decided = handler(rows.withColumn("base", base))
    chosen = F.col("decision")
    op = F.when(F.coalesce(_locked(), F.lit(False)) | ~F.col("in_local"), F.col("base")).when(chosen == "UPSERT", "UPDATE").when(chosen == "INTEGRATE", "INTEGRATE").when(chosen == "DELETE", "DELETE").otherwise("NOT_HANDLE")
    return decided.withColumn("op", op).drop("base", "decision")


def tag(local: DataFrame, cloud: DataFrame, strategy: Column) -> DataFrame:
    """Rows of both sides matched by gid, or by key where the local row has none yet, with ``op``."""
    by_gid = local.where("local_gid is not null and local_gid <> ''").join(cloud, F.col("local_gid") == F.col("cloud_gid"))
    rest_cloud = cloud.join(by_gid.select("cloud_gid"), "cloud_gid", "left_anti")
    rest_local = local.join(by_gid.select("hash_key"), "hash_key", "left_anti")
    joined = rest_cloud.join(rest_local, rest_cloud["cloud_key"] == rest_local["hash_key"], "left")
    both = by_gid.unionByName(joined.select(*by_gid.columns)).withColumn("in_local", F.col("hash_key").isNotNull())
    return both.withColumns({k: (F.coalesce(F.col(k), F.lit(False)) if t == "boolean" else F.col(k)) if k in both.columns else F.lit(None).cast(t) if t != "boolean" else F.lit(False) for k, t in INPUTS.items()}).withColumn("op", strategy)


def lock_after_change(status: Column) -> Column:
    """A locked row that changes is marked as changed."""
    return F.when(status == LOCK, LOCK_CHANGE).otherwise(status)


def lock_after_upload(status: Column, uploaded_time: Column, time: Column) -> Column:
    """A row being unlocked is free once uploaded, if it has not changed since."""
    return F.when((status == UNLOCKING) & (uploaded_time == time), UNLOCK).otherwise(status)


def row_key(columns: list[dict], table: DataFrame) -> Column:
    """Hash of the columns marked ``dup_check``, if any, else of the primary key."""
    chosen = [c["name"] for c in columns if c.get("dup_check")] or [c["name"] for c in columns if c.get("primary")]
    return composite_hash(*[table[c] for c in chosen])


def compensated(log: DataFrame, user: str) -> DataFrame:
    """Keys of one user whose sync must be made good."""
    return log.where((F.col("userid") == user) & has_bits(F.col("flag"), 0x10)).select("hash_key")


def with_log(live: DataFrame, log: DataFrame, user: str) -> DataFrame:
    """Live rows with one user's log, or none."""
    return live.join(log.where(F.col("userid") == user), "hash_key", "left")


def reset_uploads(rows: DataFrame, now: int, *, time: bool = False, uploads: bool = False) -> DataFrame:
    """Bulk status changes: fresh write times, or everything to be uploaded again."""
    if time:
        rows = rows.withColumns({"timestamp": F.lit(now), "w_timestamp": F.lit(now)})
    return rows.withColumn("flag", F.col("flag").bitwiseAND(F.lit(~0x400))) if uploads else rows

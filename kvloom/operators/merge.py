"""Last-writer-wins merging: who wins, what conflicts, what changed, what is forgotten.

Rows are identified by hash_key.  Within one batch the latest write wins and, at equal times, the
one that arrived first (``arrival``, where present).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions.scalar import has_bits

_DELETE, _LOCAL, _MISS = 0x1, 0x2, "miss_query"


def latest(batch: DataFrame, key: str = "hash_key", time: str = "w_timestamp") -> DataFrame:
    """One row for each key: the latest, the first to arrive at equal times."""
    order = F.struct(time, *([-F.col("arrival")] if "arrival" in batch.columns else []))
    return batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("__row")).select("__row.*")


def classify(existing: DataFrame, incoming: DataFrame, *, local: bool = False, force: Column | None = None) -> DataFrame:
    """Both sides of each key (structs ``old`` and ``new``) and whether the new one wins.  A tie
    keeps the old row; a local or forced write always wins."""
    old = existing.select("hash_key", F.struct(*[c for c in existing.columns if c != "hash_key"]).alias("old"))
    new = latest(incoming).drop(*(["arrival"] if "arrival" in incoming.columns else []))
    new = new.select("hash_key", F.struct(*[c for c in new.columns if c != "hash_key"]).alias("new"))
    both = old.join(new, "hash_key", "full")
    later = F.col("new.w_timestamp") > F.col("old.w_timestamp")
    forced = F.lit(local) if force is None else F.lit(local) | F.coalesce(force, F.lit(False))
    wins = F.col("new").isNotNull() & (F.col("old").isNull() | later | forced)
    return both.withColumn("wins", F.coalesce(wins, F.lit(False)))


def lww(existing: DataFrame, incoming: DataFrame, *, local: bool = False, force: Column | None = None) -> DataFrame:
    """``existing`` after the batch.  A forced win over a later row is stamped just after it."""
    columns = existing.columns
    pairs = classify(existing, incoming, local=local, force=force)
    behind = F.col("wins") & F.col("old").isNotNull() & (F.col("old.w_timestamp") >= F.col("new.w_timestamp"))
    picked = []
    for c in columns:
        if c == "hash_key":
            picked.append(F.col(c))
            continue
        value = F.when(F.col("wins"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        if c == "w_timestamp":
            value = F.when(behind, F.col("old.w_timestamp") + 1).otherwise(value)
        if c == "create_time":
            value = F.coalesce(F.col("old.create_time"), value)
        picked.append(value.alias(c))
    return pairs.select(*picked)


def ignore_own(existing: DataFrame, incoming: DataFrame, device: str = "") -> DataFrame:
    """Device collaboration: incoming rows of this device's origin, and rows that would overwrite
    this device's, are dropped."""
    mine = existing.where(has_bits(F.col("flag"), _LOCAL)).select("hash_key")
    return incoming.where(F.col("ori_device") != device).join(mine, "hash_key", "left_anti").select(*incoming.columns)


def conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """hash_key, kind, and both sides of every overwritten pair: NATIVE_ALL where the old row is
    this device's, FOREIGN_KEY_ORIG where another device changed its own row, else FOREIGN_KEY_ONLY.
    New rows, and deletes of deleted rows, are no conflict."""
    pairs = classify(existing, incoming).where("old is not null and new is not null")
    gone = has_bits(F.col("old.flag"), _DELETE) & has_bits(F.col("new.flag"), _DELETE)
    kind = F.when(has_bits(F.col("old.flag"), _LOCAL), "NATIVE_ALL").when(F.col("old.ori_device") == F.col("new.ori_device"), "FOREIGN_KEY_ORIG").otherwise("FOREIGN_KEY_ONLY")
    return pairs.where(~gone).select("hash_key", kind.alias("kind"), "old", "new", "wins")


def changes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """hash_key and _op (INSERT, UPDATE, DELETE) of what the batch changes."""
    pairs = classify(existing, incoming).where("wins")
    was = F.col("old").isNotNull() & ~has_bits(F.col("old.flag"), _DELETE)
    is_gone = has_bits(F.col("new.flag"), _DELETE)
    op = F.when(was & is_gone, "DELETE").when(was, "UPDATE").when(~is_gone, "INSERT")
    return pairs.select("hash_key", op.alias("_op")).where("_op is not null")


def erase_missed(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that the sender marked as no longer matching the query leave the store physically."""
    missed = incoming.where(_MISS).select("hash_key").distinct()
    return existing.join(missed, "hash_key", "left_anti").select(*existing.columns), incoming.where(~F.col(_MISS)).drop(_MISS)


def remove_device(rows: DataFrame, device: str | None = None, mode: str = "DEFAULT") -> DataFrame:
    """Forgets what came from one device (all, if None).  FLAG_ONLY keeps the rows as this
    device's own; the other modes remove them."""
    theirs = (F.col("device") != "") if device is None else (F.col("device") == device)
    if mode == "FLAG_ONLY":
        own = F.col("flag").bitwiseOR(F.lit(_LOCAL)).bitwiseAND(F.lit(~0x100))
        return rows.withColumn("flag", F.when(theirs, own).otherwise(F.col("flag"))).withColumn("device", F.when(theirs, "").otherwise(F.col("device")))
    return rows.where(~theirs)


def remove_except(rows: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of this device and of the devices named; and how many went."""
    stays = F.col("device").isin("", *keep)
    return rows.where(stays), rows.where(~stays).agg(F.count(F.lit(1)).alias("n"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace what has their keys."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def update_log(log: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Conditional change of log columns."""
    return log.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def purge_deleted(log: DataFrame, cursor: int) -> DataFrame:
    """Drops logically deleted rows up to a cursor."""
    return log.where(~(has_bits(F.col("flag"), 0x8) & (F.col("cursor") <= cursor)))

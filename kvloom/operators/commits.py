"""Multi-version storage: snapshots, commits with two parents, merges, differences, vacuum.

Version rows have key, value, oper_flag (ADD 1, DELETE 2, CLEAR 4; 8 once committed), version,
timestamp, ori_timestamp and hash_key; they are only appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.errors import Conflict, NotFound
from kvloom.functions.scalar import has_bits

ADD, DELETE, CLEAR, COMMITTED = 1, 2, 4, 8


def _newest(rows: DataFrame) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy("hash_key").agg(F.max_by(F.struct(*rows.columns), F.struct("version", "timestamp")).alias("__row")).select("__row.*")


def snapshot(rows: DataFrame, version: int) -> DataFrame:
    """Live entries at a version: the newest committed row of each key not before the last clear."""
    done = rows.where(has_bits(F.col("oper_flag"), COMMITTED) & (F.col("version") <= version))
    cleared = done.where(has_bits(F.col("oper_flag"), CLEAR)).agg(F.coalesce(F.max("version"), F.lit(-1)).alias("cleared"))
    kept = done.where(~has_bits(F.col("oper_flag"), CLEAR)).crossJoin(F.broadcast(cleared)).where("version > cleared").drop("cleared")
    return _newest(kept).where(~has_bits(F.col("oper_flag"), DELETE))


def snapshot_get(rows: DataFrame, version: int, key: bytes) -> DataFrame:
    return snapshot(rows.where((F.col("key") == F.lit(bytearray(key))) | has_bits(F.col("oper_flag"), CLEAR)), version).select("value")


def diff(rows: DataFrame, old: int, new: int) -> DataFrame:
    """hash_key, key and _op between two versions."""
    fold = lambda v, name: snapshot(rows, v).select("hash_key", F.struct("key", "value").alias(name))
    both = fold(old, "old").join(fold(new, "new"), "hash_key", "full")
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(~F.col("old.value").eqNullSafe(F.col("new.value")), "UPDATE")
    return both.select("hash_key", F.coalesce(F.col("new.key"), F.col("old.key")).alias("key"), op.alias("_op")).where("_op is not null")


def to_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows that a merge saves: later than what is here, and of another origin or value."""
    here = local.select("hash_key", F.col("timestamp").alias("__t"), F.col("ori_timestamp").alias("__o"), F.col("value").alias("__v"))
    both = remote.join(here, "hash_key", "left")
    fresh = F.col("__t").isNull() | (F.col("__t") < F.col("timestamp")) & ((F.col("__o") != F.col("ori_timestamp")) | ~F.col("__v").eqNullSafe(F.col("value")))
    return both.where(fresh).select(*remote.columns)


def vacuum(rows: DataFrame, oldest: int) -> DataFrame:
    """Without rows that no version from ``oldest`` on can see."""
    old = _newest(rows.where(F.col("version") <= oldest))
    return old.unionByName(rows.where(F.col("version") > oldest))


def slices(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Values in pieces stored once by their hash: (hash_key, at, slice_hash) and the pieces."""
    cut = rows.select("hash_key", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("value") / size).cast("int") - 1, F.lit(0))), lambda i: F.substr("value", i * size + 1, F.lit(size)))).alias("at", "piece"))
    named = cut.withColumn("slice_hash", F.sha2("piece", 256))
    return named.select("hash_key", "at", "slice_hash"), named.select("slice_hash", "piece").dropDuplicates(["slice_hash"])


class CommitTree:
    """The commit graph: small, so it lives on the driver."""

    def __init__(self):
        self.commits: dict[str, dict] = {}

    def add(self, left: str | None, right: str | None, version: int, timestamp: int, device: str) -> str:
        for parent in (left, right):
            if parent and parent not in self.commits:
                raise NotFound(f"no commit {parent}")
        name = hashlib.sha256(repr((left, right, version, timestamp, device)).encode()).hexdigest()
        if name in self.commits:
            raise Conflict("the commit is there already")
        self.commits[name] = {"left": left, "right": right, "version": version, "timestamp": timestamp, "device": device}
        return name

    def history(self, name: str) -> list[str]:
        """A commit and its ancestors, newest version first."""
        seen, todo = set(), [name]
        while todo:
            at = todo.pop()
            if at and at not in seen:
                seen.add(at)
                todo += [self.commits[at]["left"], self.commits[at]["right"]]
        return sorted(seen, key=lambda c: (-self.commits[c]["version"], c))

    def latest(self, device: str) -> str | None:
        mine = [c for c, x in self.commits.items() if x["device"] == device]
        return max(mine, key=lambda c: (self.commits[c]["version"], c), default=None)

    def base(self, a: str, b: str) -> str | None:
        """The newest common ancestor."""
        other = set(self.history(b))
        return next((c for c in self.history(a) if c in other), None)

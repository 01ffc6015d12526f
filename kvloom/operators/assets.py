"""Attachments: which of a row's named assets were added, removed or changed, and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSET = "struct<version:long,name:string,assetId:string,subpath:string,uri:string,modifyTime:string,createTime:string,size:string,hash:string,extension:string,flag:long,status:long,timestamp:long>"
NORMAL, DOWNLOADING, ABNORMAL, INSERT, DELETE, UPDATE = range(6)


def diff(rows: DataFrame, key: str, held: str, wanted: str, *, policy: str = "DEFAULT") -> DataFrame:
    """key, name and change for each asset of ``held`` (what is here) and ``wanted`` (what should
    be): INSERT, DELETE, UPDATE (another hash) or NO_CHANGE.  Under TIME_FIRST an asset that is
    newer here stays.  Where a name occurs twice, the last counts."""
    one = lambda c: rows.select(key, F.posexplode(c).alias("__at", "a")).select(key, F.col("a.name").alias("name"), "__at", "a")
    last = Window.partitionBy(key, "name").orderBy(F.desc("__at"))
    pick = lambda c, as_: one(c).withColumn("__n", F.row_number().over(last)).where("__n = 1").select(key, "name", F.col("a").alias(as_))
    both = pick(held, "old").join(pick(wanted, "new"), [key, "name"], "full")
    newer_here = (F.col("old.modifyTime") > F.col("new.modifyTime")) if policy == "TIME_FIRST" else F.lit(False)
    change = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(F.coalesce(newer_here, F.lit(False)), "NO_CHANGE").when(~F.col("old.hash").eqNullSafe(F.col("new.hash")), "UPDATE").otherwise("NO_CHANGE")
    return both.withColumn("change", change)


def status(direction: str, change: str = "change"):
    """Status after the diff: what is to be fetched (or sent) is pending, the rest is settled."""
    c = F.col(change)
    if direction == "download":
        return F.when(c.isin("INSERT", "UPDATE"), DOWNLOADING).when(c == "DELETE", DELETE).otherwise(NORMAL)
    return F.when(c == "INSERT", INSERT).when(c == "UPDATE", UPDATE).when(c == "DELETE", DELETE).otherwise(NORMAL)


def settled(differences: DataFrame, key: str, direction: str) -> DataFrame:
    """Each key's assets after the change, in order of name."""
    kept = differences.withColumn("status", status(direction)).withColumn("asset", F.coalesce("new", "old"))
    marked = F.struct("name", F.col("asset.hash").alias("hash"), "change", "status")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(marked)).alias("assets"))

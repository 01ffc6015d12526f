"""One batch of synchronisation between two stores: push, pull or both, by query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.functions.scalar import has_bits
from kvloom.operators.cdc import incremental, next_watermark
from kvloom.operators.joins import missed
from kvloom.operators.merge import erase_missed, lww

PUSH, PULL, PUSH_PULL = "PUSH_ONLY", "PULL_ONLY", "PUSH_PULL"


def outgoing(rows: DataFrame, since: int, until: int, matches=None, intercept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What a sender gives: rows of [since, until), tombstones too; with a query, those that no
    longer match by key only."""
    sent = incremental(rows, since, until)
    sent = sent.withColumn("miss_query", F.lit(False)) if matches is None else missed(sent, sent.where(matches))
    return sent.transform(intercept) if intercept else sent


def receive(rows: DataFrame, packet: DataFrame, device: str) -> DataFrame:
    """The receiver's store: missed rows erased, the rest merged as the sender's."""
    kept, fresh = erase_missed(rows, packet)
    theirs = fresh.withColumn("device", F.lit(device)).withColumn("flag", F.col("flag").bitwiseAND(F.lit(~0x2)))
    return lww(kept, theirs.select(*rows.columns))


def sync(here: DataFrame, there: DataFrame, mode: str, marks: dict[str, int], now: int, names: tuple[str, str] = ("here", "there"), matches=None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Both stores and the marks (``sent``, ``received``) after one run."""
    marks = dict(marks)
    new_there, new_here = there, here
    if mode in (PUSH, PUSH_PULL):
        new_there = receive(there, outgoing(here.where(has_bits(F.col("flag"), 0x2)), marks.get("sent", 0), now, matches), names[0])
        marks["sent"] = now
    if mode in (PULL, PUSH_PULL):
        new_here = receive(here, outgoing(there.where(has_bits(F.col("flag"), 0x2)), marks.get("received", 0), now, matches), names[1])
        marks["received"] = now
    return new_here, new_there, marks


__all__ = ["PUSH", "PULL", "PUSH_PULL", "next_watermark", "outgoing", "receive", "sync"]

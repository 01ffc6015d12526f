"""Joins of data with their change log, membership tests, and chains along foreign keys."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.errors import KvError


def with_log(data: DataFrame, log: DataFrame, row: str, data_key: str = "data_key") -> DataFrame:
    """Rows that have a log entry."""
    return data.join(log, data[row] == log[data_key])


def log_with_data(log: DataFrame, data: DataFrame, row: str, data_key: str = "data_key") -> DataFrame:
    """Every log entry, with its row where that is still there."""
    return log.join(data, log[data_key] == data[row], "left")


def members(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    return rows.join(of.select(key), key, "left_semi")


def strangers(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those of ``of``.  A null key is left out, as by NOT IN; nulls of
    ``of``, which the keys of a log never are, are not looked at."""
    return rows.where(F.col(key).isNotNull()).join(of.select(key), key, "left_anti")


def missed(changed: DataFrame, matching: DataFrame, key: str = "hash_key", value: str = "value") -> DataFrame:
    """Changed rows; those that no longer match the query go by key only, marked ``miss_query``."""
    marks = matching.select(key).distinct().withColumn("__match", F.lit(True))
    both = changed.join(marks, key, "left").withColumn("miss_query", F.col("__match").isNull()).drop("__match")
    return both.withColumn(value, F.when(~F.col("miss_query"), F.col(value)))


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str


def neighbours(keys: list[ForeignKey]) -> dict[str, list[tuple[str, ForeignKey, bool]]]:
    found: dict[str, list[tuple[str, ForeignKey, bool]]] = {}
    for k in keys:
        found.setdefault(k.table, []).append((k.parent, k, True))
        found.setdefault(k.parent, []).append((k.table, k, False))
    return found


def path(keys: list[ForeignKey], start: str, goal: str) -> list[tuple[str, ForeignKey, bool]]:
    """Steps from ``start`` to ``goal`` along keys in either direction, fewest first; tables already
    reached are not entered again, so cycles end."""
    around, came, todo = neighbours(keys), {start: None}, deque([start])
    while todo:
        at = todo.popleft()
        if at == goal:
            break
        for step in around.get(at, []):
            if step[0] not in came:
                came[step[0]] = (at, step)
                todo.append(step[0])
    if goal not in came:
        raise KvError(f"no keys lead from {start} to {goal}", "NOT_FOUND")
    steps = []
    while came[goal] is not None:
        goal, step = came[goal]
        steps.append(step)
    return steps[::-1]


def chain(tables: dict[str, DataFrame], keys: list[ForeignKey], start: str, goals: list[str]) -> DataFrame:
    """``start`` left-joined along the paths to the tables that are needed, each joined once."""
    out, done = tables[start], {start}
    for goal in goals:
        at = start
        for name, key, up in path(keys, start, goal):
            if name not in done:
                mine, theirs = (key.column, key.parent_column) if up else (key.parent_column, key.column)
                right = tables[name]
                clash = set(out.columns) & set(right.columns)
                right = right.withColumnsRenamed({c: f"{name}_{c}" for c in clash})
                out = out.join(right, out[mine] == right[f"{name}_{theirs}" if theirs in clash else theirs], "left")
                done.add(name)
            at = name
    return out


def sync_order(tables: list[str], keys: list[ForeignKey]) -> list[str]:
    """Parents before children; tables on a cycle keep the given order, after those that are free."""
    left, out = list(tables), []
    while left:
        free = [t for t in left if not any(k.table == t and k.parent in left and k.parent != t for k in keys)]
        out += free or left[:1]
        left = [t for t in left if t not in out]
    return out


def after_cursor(columns: list[str], cursor: list, *, upper: list | None = None) -> Column:
    """Keyset pagination: rows whose columns come after ``cursor`` in lexicographic order, nulls
    first; with ``upper``, not beyond it."""

    def beyond(limits: list, strict: bool) -> Column:
        test = F.lit(not strict)
        for name, value in reversed(list(zip(columns, limits))):
            column = F.col(name)
            greater = column.isNotNull() if value is None else F.coalesce(column > F.lit(value), F.lit(False))
            test = greater | (column.eqNullSafe(F.lit(value)) & test)
        return test

    found = beyond(cursor, True)
    return found if upper is None else found & (~beyond(upper, True))


def page(rows: DataFrame, columns: list[str], cursor: list | None, size: int = 1000, upper: list | None = None) -> DataFrame:
    if cursor is not None:
        rows = rows.where(after_cursor(columns, cursor, upper=upper))
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in columns]).limit(size)

"""Queries as columns: predicates, order and limit for Catalyst to plan.

Everything is built from native expressions, so filters reach the scan where the source allows it.
A binary key prefix is written as a range as well, which Parquet statistics can use.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.errors import QueryFieldError, QueryFormatError
from kvloom.plans.query import COMPARE, LINKERS, MAX_RANGE_VALUES, Node, Query, path_of, validate

Resolve = Callable[[str], tuple[Column, str]]
#: Field types of schemas and the Spark types that comparisons happen in.
CASTS = {"BOOL": "int", "INTEGER": "int", "LONG": "bigint", "DOUBLE": "double", "STRING": "string"}
_COMPARE = dict(zip(COMPARE, (operator.eq, operator.ne, operator.gt, operator.lt, operator.ge, operator.le)))


def like(text: Column, pattern: str) -> Column:
    """LIKE without an escape character, blind to ASCII case only."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    folded = pattern.translate({c: c + 32 for c in range(65, 91)}).replace("\\", "\\\\")
    return fold(text).like(folded)


def literal(value, field_type: str) -> Column:
    """The literal in the field's type: the column side decides how values compare."""
    if isinstance(value, bool):
        value = int(value)
    wanted = CASTS.get(field_type)
    return F.lit(value) if wanted is None else F.lit(value).try_cast(wanted)


def starts_with(key: Column, prefix: bytes) -> Column:
    """Binary prefix test, with its range for pruning."""
    if not prefix:
        return key.isNotNull()
    low = key >= F.lit(bytearray(prefix))
    stem = prefix.rstrip(b"\xff")
    test = F.substring(key, 1, len(prefix)) == F.lit(bytearray(prefix))
    if stem:
        low = low & (key < F.lit(bytearray(stem[:-1] + bytes([stem[-1] + 1]))))
    return low & test


def one_of(column: Column, values, field_type: str = "") -> Column:
    """Membership; Spark turns long lists into hash sets."""
    return column.isin([literal(v, field_type) for v in values]) if values else F.lit(False)


def key_condition(query: Query, key: Column) -> Column | None:
    found = []
    for node in query.of("prefix", "in_keys", "range"):
        if node.op == "prefix":
            found.append(starts_with(key, node.values[0]))
        elif node.op == "in_keys":
            found.append(key.isin([F.lit(bytearray(k)) for k in node.values]))
        else:
            begin, end = node.values
            parts = [key >= F.lit(bytearray(begin))] if begin else []
            parts += [key <= F.lit(bytearray(end))] if end else []
            found.append(functools.reduce(operator.and_, parts) if parts else key.isNotNull())
    return functools.reduce(operator.and_, found) if found else None


def predicate(node: Node, resolve: Resolve) -> Column:
    if node.op == "assets":
        wanted = json.loads(node.values[0])
        tests = [F.exists(resolve(name)[0], lambda a, names=names: a["name"].isin(names)) for name, names in wanted.items()]
        return functools.reduce(operator.and_, tests)
    column, kind = resolve(node.field)
    if node.op in _COMPARE:
        return _COMPARE[node.op](column, literal(node.values[0], kind))
    if node.op in ("like", "not_like"):
        found = like(column.cast("string"), str(node.values[0]))
        return ~found if node.op == "not_like" else found
    if node.op == "is_null":
        return column.isNull()
    if node.op == "is_not_null":
        return column.isNotNull()
    if len(node.values) > MAX_RANGE_VALUES:
        raise QueryFormatError(f"at most {MAX_RANGE_VALUES} values in a set")
    found = one_of(column, node.values, kind)
    return ~found if node.op == "not_in" else found


def condition(query: Query, resolve: Resolve) -> Column | None:
    """The conditions as one column; and binds tighter than or (shunting-yard)."""
    output: list[Column] = []
    waiting: list[str] = []

    def combine() -> None:
        op = waiting.pop()
        right, left = output.pop(), output.pop()
        output.append(left & right if op == "and" else left | right)

    for node in query.conditions():
        if node.op == "(":
            waiting.append("(")
        elif node.op == ")":
            while waiting[-1] != "(":
                combine()
            waiting.pop()
        elif node.op in LINKERS:
            while waiting and waiting[-1] != "(" and (waiting[-1] == "and" or node.op == "or"):
                combine()
            waiting.append(node.op)
        else:
            output.append(predicate(node, resolve))
    while waiting:
        combine()
    return output[0] if output else None


def columns_of(df: DataFrame) -> Resolve:
    """Fields are the columns of a table; a leading ``$.`` is dropped and names ignore case."""
    known = {c.lower(): c for c in df.columns}

    def resolve(name: str) -> tuple[Column, str]:
        parts = path_of(name)
        column = known.get(parts[0].lower())
        if column is None:
            raise QueryFieldError(f"no field {name!r}")
        return F.col(".".join([f"`{column}`", *parts[1:]])), ""

    return resolve


def where(df: DataFrame, query: Query, resolve: Resolve | None = None, key: Column | None = None) -> DataFrame:
    """Rows that the key conditions and the (parenthesised) predicates both keep."""
    if key is not None and (test := key_condition(query, key)) is not None:
        df = df.where(test)
    test = condition(query, resolve or columns_of(df))
    return df if test is None else df.where(test)


def ordered(df: DataFrame, query: Query, resolve: Resolve | None = None, write_time: Column | None = None) -> DataFrame:
    """Order (nulls smallest) and then limit; a negative limit is none."""
    resolve = resolve or columns_of(df)
    orders = []
    for node in query.of("order_by", "order_by_write_time"):
        column = resolve(node.field)[0] if node.op == "order_by" else (F.col("timestamp") if write_time is None else write_time)
        orders.append(column.asc_nulls_first() if node.values[0] else column.desc_nulls_last())
    if orders:
        df = df.orderBy(*orders)
    for node in query.of("limit"):
        number, offset = node.values
        if offset > 0:
            df = df.offset(offset)
        if number >= 0:
            df = df.limit(number)
    return df


def run(df: DataFrame, query: Query, resolve: Resolve | None = None, key: Column | None = None) -> DataFrame:
    """A checked query over a table."""
    validate(query)
    resolve = resolve or columns_of(df)
    return ordered(where(df, query, resolve, key), query, resolve)


def count(df: DataFrame, query: Query, resolve: Resolve | None = None, key: Column | None = None) -> DataFrame:
    """One row, ``n``."""
    validate(query, count=True)
    return where(df, query, resolve, key).agg(F.count(F.lit(1)).alias("n"))


#: Predicate names of a data-share style caller and the builder methods they stand for.
ADAPTERS = {
    "equalTo": "equal_to", "notEqualTo": "not_equal_to", "greaterThan": "greater_than", "lessThan": "less_than",
    "greaterThanOrEqualTo": "greater_than_or_equal_to", "lessThanOrEqualTo": "less_than_or_equal_to",
    "like": "like", "unlike": "not_like", "isNull": "is_null", "isNotNull": "is_not_null", "in": "in_", "notIn": "not_in",
    "and": "and_", "or": "or_", "beginWrap": "begin_group", "endWrap": "end_group", "keyPrefix": "prefix_key", "inKeys": "in_keys",
    "limit": "limit",
}


def from_predicates(steps: list[tuple]) -> Query:
    """A query from (name, arguments…) rows."""
    query = Query()
    for name, *args in steps:
        if name in ("orderByAsc", "orderByDesc"):
            query = query.order_by(args[0], name == "orderByAsc")
        elif name in ADAPTERS:
            query = getattr(query, ADAPTERS[name])(*args)
        else:
            raise QueryFormatError(f"unknown predicate {name!r}")
    return query

"""The fluent query: a list of nodes, checked as a whole, with a text form and an identity.

A query is data.  ``kvloom.plans.compiler`` turns it into columns; nothing here touches Spark.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from kvloom.errors import LimitError, QueryFieldError, QueryFormatError

MAX_NODES = 256
MAX_KEY = 1024
MAX_IN_KEYS = 128
MAX_IN_VALUES = 128
MAX_CLOUD_IN_VALUES = 100
MAX_RANGE_VALUES = 128
MAX_PATH_DEPTH = 4
MAX_FIELD_NAME = 64

COMPARE = ("eq", "ne", "gt", "lt", "ge", "le")
ORDERED = ("gt", "lt", "ge", "le")
PREDICATES = (*COMPARE, "like", "not_like", "is_null", "is_not_null", "in", "not_in")
LINKERS = ("and", "or")
GROUPS = ("(", ")")
KEYS = ("prefix", "in_keys", "range")
SHAPES = ("order_by", "order_by_write_time", "limit", "suggest_index")

Value = bool | int | float | str | None


def kind_of(value: Value) -> str:
    """The literal's type tag."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOL"
    if isinstance(value, int):
        return "INTEGER" if -(1 << 31) <= value < 1 << 31 else "LONG"
    if isinstance(value, float):
        return "DOUBLE"
    if isinstance(value, str):
        return "STRING"
    raise QueryFormatError(f"a {type(value).__name__} is no query literal")


@dataclass(frozen=True)
class Node:
    op: str
    field: str = ""
    values: tuple = ()

    def as_json(self) -> list:
        values = [["BYTES", v.hex()] if isinstance(v, bytes) else [kind_of(v), v] for v in self.values]
        return [self.op, self.field, values]

    @classmethod
    def from_json(cls, row: list) -> Node:
        return cls(row[0], row[1], tuple(bytes.fromhex(v) if kind == "BYTES" else v for kind, v in row[2]))


def path_of(name: str) -> tuple[str, ...]:
    """The parts of a field path; a leading ``$.`` is optional."""
    bare = name[2:] if name.startswith("$.") else name
    parts = tuple(bare.split("."))
    if not bare or any(not p for p in parts):
        raise QueryFieldError(f"empty part in path {name!r}")
    if len(parts) > MAX_PATH_DEPTH:
        raise QueryFieldError(f"path {name!r} is deeper than {MAX_PATH_DEPTH}")
    for part in parts:
        if len(part) > MAX_FIELD_NAME or not all(c.isalnum() or c == "_" for c in part) or part[0].isdigit():
            raise QueryFieldError(f"bad field name {part!r}")
    return parts


def _key(key: bytes | str) -> bytes:
    raw = key.encode() if isinstance(key, str) else bytes(key)
    if len(raw) > MAX_KEY:
        raise LimitError(f"a key has at most {MAX_KEY} bytes")
    return raw


@dataclass(frozen=True)
class Query:
    """Immutable: every call returns a longer query."""

    nodes: tuple[Node, ...] = ()
    table: str | None = None
    tables: tuple[str, ...] = ()
    device: str | None = None
    parts: tuple[tuple[str, Query], ...] = field(default=())

    def _add(self, op: str, name: str = "", values: Iterable = ()) -> Query:
        return replace(self, nodes=(*self.nodes, Node(op, name, tuple(values))))

    # sources
    @classmethod
    def select(cls, table: str | None = None) -> Query:
        return cls(table=table)

    def from_(self, table: str) -> Query:
        """Starts the conditions of ``table`` in a query over several tables; conditions so far
        stay with the table before."""
        if self.table is None:
            if self.nodes:
                raise QueryFormatError("conditions before the first table")
            return replace(self, table=table)
        return replace(self, nodes=(), table=table, parts=(*self.parts, (self.table, Query(self.nodes, self.table))))

    def from_tables(self, names: Iterable[str]) -> Query:
        return replace(self, tables=tuple(dict.fromkeys(names)))

    def by_table(self) -> dict[str, Query]:
        """One query for each table named."""
        if self.tables:
            if self.nodes:
                raise QueryFormatError("a set of tables takes no conditions")
            return {t: Query(table=t) for t in self.tables}
        found = dict(self.parts)
        if self.table is not None:
            if self.table in found:
                raise QueryFormatError(f"table {self.table!r} twice")
            found[self.table] = replace(self, parts=())
        return found

    # predicates
    def equal_to(self, name: str, value: Value) -> Query:
        return self._add("eq", name, [value])

    def not_equal_to(self, name: str, value: Value) -> Query:
        return self._add("ne", name, [value])

    def greater_than(self, name: str, value: Value) -> Query:
        return self._add("gt", name, [value])

    def less_than(self, name: str, value: Value) -> Query:
        return self._add("lt", name, [value])

    def greater_than_or_equal_to(self, name: str, value: Value) -> Query:
        return self._add("ge", name, [value])

    def less_than_or_equal_to(self, name: str, value: Value) -> Query:
        return self._add("le", name, [value])

    def like(self, name: str, pattern: str) -> Query:
        return self._add("like", name, [pattern])

    def not_like(self, name: str, pattern: str) -> Query:
        return self._add("not_like", name, [pattern])

    def is_null(self, name: str) -> Query:
        return self._add("is_null", name)

    def is_not_null(self, name: str) -> Query:
        return self._add("is_not_null", name)

    def in_(self, name: str, values: Iterable[Value]) -> Query:
        return self._add("in", name, values)

    def not_in(self, name: str, values: Iterable[Value]) -> Query:
        return self._add("not_in", name, values)

    def and_(self) -> Query:
        return self._add("and")

    def or_(self) -> Query:
        return self._add("or")

    def begin_group(self) -> Query:
        return self._add("(")

    def end_group(self) -> Query:
        return self._add(")")

    def between(self, name: str, low: Value, high: Value) -> Query:
        return self.greater_than_or_equal_to(name, low).and_().less_than_or_equal_to(name, high)

    # keys
    def prefix_key(self, prefix: bytes | str) -> Query:
        return self._add("prefix", values=[_key(prefix)])

    def in_keys(self, keys: Iterable[bytes | str]) -> Query:
        return self._add("in_keys", values=[_key(k) for k in keys])

    def range(self, begin: bytes | str, end: bytes | str) -> Query:
        return self._add("range", values=[_key(begin), _key(end)])

    def device_id(self, device: str) -> Query:
        return replace(self, device=device)

    def assets_only(self, wanted: dict[str, Iterable[str]]) -> Query:
        """Only rows with one of the named assets in each field; follows ``and_``."""
        return self._add("assets", values=[json.dumps({k: sorted(v) for k, v in sorted(wanted.items())})])

    # shape
    def order_by(self, name: str, ascending: bool = True) -> Query:
        return self._add("order_by", name, [ascending])

    def order_by_write_time(self, ascending: bool = True) -> Query:
        return self._add("order_by_write_time", values=[ascending])

    def limit(self, number: int, offset: int = 0) -> Query:
        return self._add("limit", values=[number, offset])

    def suggest_index(self, name: str) -> Query:
        return self._add("suggest_index", name)

    # views
    def conditions(self) -> list[Node]:
        return [n for n in self.nodes if n.op not in (*SHAPES, *KEYS)]

    def of(self, *ops: str) -> list[Node]:
        return [n for n in self.nodes if n.op in ops]

    # text form and identity
    def to_json(self) -> str:
        body = {"nodes": [n.as_json() for n in self.nodes], "table": self.table, "tables": list(self.tables), "device": self.device, "parts": [[t, q.to_json()] for t, q in self.parts]}
        return json.dumps(body, separators=(",", ":"), sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Query:
        body = json.loads(text)
        return cls(tuple(Node.from_json(n) for n in body["nodes"]), body["table"], tuple(body["tables"]), body["device"], tuple((t, cls.from_json(q)) for t, q in body["parts"]))

    def identity(self) -> str:
        """Hash of what is selected: order, limit and hints do not count, so queries that differ
        in these share a watermark."""
        core = replace(self, nodes=tuple(n for n in self.nodes if n.op not in SHAPES))
        return hashlib.sha256(core.to_json().encode()).hexdigest()


def validate(query: Query, *, has_schema: bool = True, count: bool = False, cloud: bool = False, sync: bool = False) -> Query:
    """Checks the whole query and returns it."""
    nodes = query.nodes
    if len(nodes) > MAX_NODES:
        raise LimitError(f"a query has at most {MAX_NODES} nodes")
    for op, once in (("prefix", "prefix"), ("in_keys", "key set"), ("range", "key range"), ("limit", "limit"), ("suggest_index", "index hint"), ("order_by_write_time", "write time order")):
        if len(query.of(op)) > 1:
            raise QueryFormatError(f"more than one {once}")
    if query.of("range"):
        if len(nodes) > 1:
            raise QueryFormatError("a key range must be the only condition")
        if sync:
            raise QueryFormatError("a key range cannot be synchronised", "NOT_SUPPORT")
    for node in query.of("in_keys"):
        if not 1 <= len(node.values) <= MAX_IN_KEYS or any(not k for k in node.values):
            raise LimitError(f"a key set has 1 to {MAX_IN_KEYS} keys, none empty")
    if query.of("order_by_write_time") and any(n.op in PREDICATES or n.op == "order_by" for n in nodes):
        raise QueryFormatError("write time order goes with key conditions only")
    if count and query.of("limit", "order_by", "order_by_write_time"):
        raise QueryFormatError("a count takes no limit or order", "NOT_SUPPORT")
    _shape(nodes)
    _links(query.conditions(), cloud)
    for node in nodes:
        if node.op in PREDICATES or node.op == "order_by":
            if not has_schema:
                raise QueryFormatError("fields need a schema", "NOT_SUPPORT")
            path_of(node.field)
        if node.op in ORDERED and isinstance(node.values[0], bool):
            raise QueryFormatError("booleans have no order")
        if node.op in ("in", "not_in"):
            most = MAX_CLOUD_IN_VALUES if cloud else MAX_IN_VALUES
            if len(node.values) > most:
                raise LimitError(f"at most {most} values in a set")
    return query


def _shape(nodes: tuple[Node, ...]) -> None:
    places = {op: [i for i, n in enumerate(nodes) if n.op == op] for op in SHAPES}
    last = len(nodes) - 1
    for i in places["suggest_index"]:
        if i != last:
            raise QueryFormatError("an index hint comes last")
    for i in places["limit"]:
        if any(n.op != "suggest_index" for n in nodes[i + 1 :]):
            raise QueryFormatError("a limit comes last or before the index hint")
    orders = places["order_by"] + places["order_by_write_time"]
    if orders and any(n.op in (*PREDICATES, *LINKERS, *GROUPS) for n in nodes[min(orders) :]):
        raise QueryFormatError("conditions come before the order")


def _links(conditions: list[Node], cloud: bool) -> None:
    depth, before = 0, None
    for node in conditions:
        op = node.op
        operand = op in PREDICATES or op == "assets"
        if op == "assets" and (before is None or before.op != "and"):
            raise QueryFormatError("an asset condition follows and")
        if operand or op == "(":
            if before is not None and (before.op in PREDICATES or before.op in (")", "assets")):
                raise QueryFormatError("two conditions without and or or between them")
        elif before is None or before.op in LINKERS or before.op == "(":
            raise QueryFormatError(f"{op} has nothing before it")
        if cloud and before is not None and before == node:
            raise QueryFormatError("the same node twice in a row")
        depth += (op == "(") - (op == ")")
        if depth < 0:
            raise QueryFormatError("a group ends that never began")
        before = node
    if depth:
        raise QueryFormatError("a group never ends")
    if before is not None and before.op in (*LINKERS, "("):
        raise QueryFormatError(f"{before.op} has nothing after it")

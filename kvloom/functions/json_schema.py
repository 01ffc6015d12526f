"""Schemas of JSON values: parsing, typed extraction, amendment on write, and evolution."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvloom.errors import LimitError, QueryFieldError, SchemaMismatch
from kvloom.plans.compiler import CASTS
from kvloom.plans.query import MAX_FIELD_NAME, MAX_PATH_DEPTH, path_of

MAX_FIELDS, MAX_INDEXES = 256, 32
MAX_SCHEMA_BYTES, MAX_DEFAULT_BYTES = 512 << 10, 4 << 10
MAX_SKIP = (4 << 20) - 2
MODES = ("STRICT", "COMPATIBLE")
LEAVES = ("BOOL", "INTEGER", "LONG", "DOUBLE", "STRING")
_WIDER = {"INTEGER": ("INTEGER",), "LONG": ("INTEGER", "LONG"), "DOUBLE": ("INTEGER", "LONG", "DOUBLE")}


@dataclass(frozen=True)
class Leaf:
    kind: str
    not_null: bool = False
    default: object = None
    has_default: bool = False


def _leaf(text: str) -> Leaf:
    """``TYPE[, NOT NULL][, DEFAULT value]``."""
    parts = [p.strip() for p in text.split(",", 2)]
    kind, rest = parts[0].upper(), parts[1:]
    if kind not in LEAVES:
        raise SchemaMismatch(f"unknown type {parts[0]!r}")
    not_null, default, has_default = False, None, False
    while rest:
        part = rest.pop(0)
        if part.upper() == "NOT NULL":
            not_null = True
        elif part.upper().startswith("DEFAULT"):
            raw = ",".join([part[7:], *rest]).strip()
            rest = []
            if len(raw.encode()) > MAX_DEFAULT_BYTES:
                raise LimitError("the default is too long")
            default, has_default = _default(kind, raw), True
        else:
            raise SchemaMismatch(f"cannot read attribute {part!r}")
    return Leaf(kind, not_null, default, has_default)


def _default(kind: str, raw: str) -> object:
    if raw == "null":
        return None
    if kind == "STRING":
        if len(raw) < 2 or raw[0] != "'" or raw[-1] != "'":
            raise SchemaMismatch("a text default stands in single quotes")
        return raw[1:-1]
    if kind == "BOOL":
        if raw not in ("true", "false"):
            raise SchemaMismatch(f"{raw!r} is no boolean")
        return raw == "true"
    try:
        return float(raw) if kind == "DOUBLE" else int(raw)
    except ValueError:
        raise SchemaMismatch(f"{raw!r} is no {kind}") from None


@dataclass(frozen=True)
class Schema:
    """Leaves by path; an empty object or an array is opaque."""

    mode: str
    fields: dict[tuple[str, ...], Leaf]
    indexes: tuple[tuple[tuple[str, ...], ...], ...] = ()
    skip: int = 0
    objects: frozenset[tuple[str, ...]] = field(default_factory=frozenset)

    @classmethod
    def parse(cls, text: str) -> Schema:
        if len(text.encode()) > MAX_SCHEMA_BYTES:
            raise LimitError("the schema is too long")
        body = json.loads(text)
        mode = body.get("SCHEMA_MODE")
        if mode not in MODES or "SCHEMA_VERSION" not in body or not isinstance(body.get("SCHEMA_DEFINE"), dict):
            raise SchemaMismatch("a schema has a version, a mode and a definition")
        fields: dict[tuple[str, ...], Leaf] = {}
        objects: set[tuple[str, ...]] = set()

        def walk(node: dict, at: tuple[str, ...]) -> None:
            for name, value in node.items():
                path = (*at, name)
                if len(path) > MAX_PATH_DEPTH or len(name) > MAX_FIELD_NAME:
                    raise LimitError(f"{'.'.join(path)} is too deep or too long")
                path_of(name)
                if isinstance(value, dict) and value:
                    objects.add(path)
                    walk(value, path)
                elif isinstance(value, dict):
                    fields[path] = Leaf("OBJECT")
                elif isinstance(value, list):
                    fields[path] = Leaf("ARRAY")
                else:
                    fields[path] = _leaf(str(value))

        walk(body["SCHEMA_DEFINE"], ())
        if len(fields) > MAX_FIELDS:
            raise LimitError(f"at most {MAX_FIELDS} fields")
        indexes = []
        for entry in body.get("SCHEMA_INDEXES", []):
            paths = tuple(path_of(p) for p in ([entry] if isinstance(entry, str) else entry))
            if any(p not in fields or fields[p].kind not in LEAVES for p in paths):
                raise SchemaMismatch(f"index {entry!r} is on no plain field")
            indexes.append(paths)
        if len(indexes) > MAX_INDEXES:
            raise LimitError(f"at most {MAX_INDEXES} indexes")
        skip = int(body.get("SCHEMA_SKIPSIZE", 0))
        if not 0 <= skip <= MAX_SKIP:
            raise LimitError("bad skip size")
        return cls(mode, fields, tuple(indexes), skip, frozenset(objects))

    def parsed(self, value: Column) -> Column:
        """The value as a variant, without the bytes that the schema skips; bad JSON is null."""
        text = F.substring(value, self.skip + 1, 1 << 30) if self.skip else value
        return F.try_parse_json(text.cast("string"))

    def extract(self, document: Column, name: str) -> tuple[Column, str]:
        """A leaf of a parsed value in its type: missing, null, array and object are null."""
        path = path_of(name)
        leaf = self.fields.get(path)
        if leaf is None or leaf.kind not in LEAVES:
            raise QueryFieldError(f"no plain field {name!r}")
        return extract(document, path, leaf.kind), leaf.kind

    def resolver(self, document: Column):
        return lambda name: self.extract(document, name)

    def problems(self, document: Column) -> Column:
        """Names of the rules that a parsed value breaks, empty if none."""
        tests = [(F.lit("not JSON"), document.isNull())]
        for path, leaf in self.fields.items():
            kind = F.schema_of_variant(_get(document, path, "variant"))
            label = F.lit(".".join(path))
            missing = F.coalesce(kind == "VOID", F.lit(True))
            if leaf.not_null and not (leaf.has_default and leaf.default is not None):
                tests.append((label, missing))
            tests.append((label, ~missing & ~_fits(kind, _get(document, path, "variant"), leaf.kind)))
        if self.mode == "STRICT":
            for at in [(), *sorted(self.objects)]:
                known = sorted({p[len(at)] for p in self.fields if p[: len(at)] == at and len(p) > len(at)})
                names = F.json_object_keys(F.to_json(document) if not at else F.to_json(_get(document, at, "variant")))
                tests.append((F.lit("undefined field"), F.size(F.array_except(names, F.array(*map(F.lit, known)))) > 0))
        return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), label) for label, test in tests]), lambda x: x.isNotNull())

    def amended(self, document: Column) -> Column:
        """Every plain field by path, with the default where the value has none."""
        out = []
        for path, leaf in self.fields.items():
            if leaf.kind in LEAVES:
                found = extract(document, path, leaf.kind)
                if leaf.has_default and leaf.default is not None:
                    default = int(leaf.default) if isinstance(leaf.default, bool) else leaf.default
                    found = F.coalesce(found, F.lit(default).cast(CASTS[leaf.kind]))
                out.append(found.alias("_".join(path)))
        return F.struct(*out)

    def compare(self, new: Schema) -> str:
        """EQUAL, COMPATIBLE (indexes differ), COMPATIBLE_UPGRADE (fields were added that old
        values can lack) or INCOMPATIBLE."""
        if self.skip != new.skip or (self.mode == "COMPATIBLE" and new.mode != self.mode):
            return "INCOMPATIBLE"
        if any(new.fields.get(p) != leaf for p, leaf in self.fields.items()):
            return "INCOMPATIBLE"
        added = [leaf for p, leaf in new.fields.items() if p not in self.fields]
        if any(leaf.not_null and not (leaf.has_default and leaf.default is not None) for leaf in added):
            return "INCOMPATIBLE"
        if added or self.mode != new.mode:
            return "COMPATIBLE_UPGRADE"
        return "EQUAL" if set(self.indexes) == set(new.indexes) else "COMPATIBLE"


def _get(document: Column, path: tuple[str, ...], kind: str) -> Column:
    return F.try_variant_get(document, "$" + "".join(f".{p}" for p in path), kind)


def extract(document: Column, path: tuple[str, ...], kind: str) -> Column:
    """A leaf in the given type; booleans come as 0 and 1, arrays and objects as null."""
    found = _get(document, path, CASTS[kind] if kind != "BOOL" else "boolean")
    if kind == "BOOL":
        found = found.cast("int")
    if kind == "STRING":
        shape = F.schema_of_variant(_get(document, path, "variant"))
        found = F.when(~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), found)
    return found


def _fits(shape: Column, value: Column, kind: str) -> Column:
    """Whether a value that is there has the field's type; whole numbers widen."""
    if kind == "BOOL":
        return shape == "BOOLEAN"
    if kind == "STRING":
        return shape == "STRING"
    if kind == "ARRAY":
        return shape.startswith("ARRAY")
    if kind == "OBJECT":
        return shape.startswith("OBJECT")
    whole = shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    if kind == "LONG":
        return whole
    if kind == "INTEGER":
        number = F.try_variant_get(value, "$", "bigint")
        return whole & number.between(-(1 << 31), (1 << 31) - 1)
    return whole | shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT")
